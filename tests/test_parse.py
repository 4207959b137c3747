import io
import json
import random
import zipfile
from html import escape

from pyspark.sql import functions as F

from corpusloom.functions.json_text import json_to_text, spaced_json
from corpusloom.sources import files, parse

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, name="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, f'<?xml version="1.0"?><w:document {W}>{body}</w:document>')
        z.writestr("other.xml", "<x/>")
    return out.getvalue()


def para(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{escape(r)}</w:t></w:r>" for r in runs) + "</w:p>"


def table(rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{''.join(para(p) for p in cell)}</w:tc>" for cell in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def walk(node, path):
    """The lines of a content tree, by recursion."""
    if not isinstance(node, dict):
        return
    title = str(node.get("title") or "").strip()
    path = [*path, title] if title else path
    if title:
        yield " / ".join(path)
    below = node.get("children")
    for child in below if isinstance(below, list) else ():
        yield from walk(child, path)
    if isinstance(below, str) and below.strip():
        yield below.strip()


def brute(raw):
    try:
        data = json.loads(raw)
    except ValueError:
        return None
    payload = data.get("data", data) if isinstance(data, dict) else data
    if not isinstance(payload, dict):
        return json.dumps(data, ensure_ascii=False)
    head = [str(payload.get("title") or "")] + [f"{label}{payload.get(key) or ''}" for label, key in (("制定机关：", "zdjgName"), ("公布日期：", "gbrq"), ("施行日期：", "sxrq"), ("法规类型：", "flxz"))]
    return "\n".join(x for x in [*[h.strip() for h in head], *walk(payload.get("content"), [])] if x)


def tree(rng, depth):
    node = {"title": rng.choice(["第一章 总则", " x ", "", None, 7, 0, 2.5, True, False])}
    kind = rng.random()
    if depth and kind < 0.7:
        node["children"] = [tree(rng, depth - 1) if rng.random() < 0.9 else rng.choice([5, "s", None, []]) for _ in range(rng.randint(0, 4))]
    elif kind < 0.9:
        node["children"] = rng.choice(["正文。", "  ", "line\nline", {"a": 1}, 9])
    return node


def test_json_against_recursion(spark):
    rng = random.Random(5)
    docs = [{rng.choice(["data", "other"]): 1, "title": "t"} for _ in range(3)]
    docs += [{"data": {"title": rng.choice(["法", "", None, 3]), "zdjgName": rng.choice(["机关", None]), "gbrq": "2024", "content": tree(rng, rng.randint(0, 6))}} for _ in range(150)]
    docs += [{"title": "bare", "flxz": " 法律 ", "content": tree(rng, 4)}, [1, "a, b: c", {"k": None, "a": [True]}], 5, None, "text", {"data": [1, {"b": 2}]}, {"data": None}, {}, {"content": "s"}]
    deep = {"title": "leaf", "children": "end"}
    for i in range(120):
        deep = {"title": f"n{i}", "children": [{"children": f"before {i}"}, deep]}
    raws = [json.dumps(x, ensure_ascii=False) for x in [*docs, {"content": deep}]] + ["{broken", "", '{"a":1', '{"a": 1} x', None]
    got = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", json_to_text(F.col("raw")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: None if raw is None else brute(raw) for i, raw in enumerate(raws)}


def test_json_plan_stays_in_its_row(spark):
    plan = spark.createDataFrame([("{}",)], "raw string").select(json_to_text(F.col("raw")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_spaced_json(spark):
    raw = '{"a":[1,2, {"b":"x, y: \\" z"}],"c" : null}'
    assert spark.range(1).select(spaced_json(F.lit(raw))).first()[0] == json.dumps(json.loads(raw), ensure_ascii=False)


def test_docx_blocks_in_order():
    body = para("第一条 ", "内容 <a> & b") + para("  ") + table([[["A", "", "B"], ["x & \"y\""]], []]) + "<w:sdt><w:p/></w:sdt>" + table([]) + para("end")
    got = parse.read_docx(docx(f"<w:body>{body}</w:body>"))
    assert got == "第一条 内容 <a> & b\n<table><tr><td>A\nB</td><td>x &amp; &quot;y&quot;</td></tr></table>\nend"
    assert parse.read_docx(docx("")) == ""
    nested = "<w:body><w:tbl><w:tr><w:tc>" + para("outer") + table([[["inner"]]]) + "</w:tc></w:tr></w:tbl></w:body>"
    assert parse.read_docx(docx(nested)) == "<table><tr><td>outer</td></tr></table>"
    many = "".join(para(f"p{i}") for i in range(5000))
    assert parse.read_docx(docx(f"<w:body>{many}</w:body>")).count("\n") == 4999


def test_docx_failures_are_rows(spark):
    good = docx(f"<w:body>{para('fine')}</w:body>")
    rows = [("a", good), ("b", b"plain"), ("c", good[: len(good) // 2]), ("d", docx("", "word/other.xml")), ("e", docx("<w:body><w:p></w:body>")), ("f", b""), ("g", None)]
    df = spark.createDataFrame([(n, ".docx", f"x/{n}.docx", c) for n, c in rows], "stem string, suffix string, path string, content binary")
    got = {r.stem: r for r in parse.parse_files(df).collect()}
    assert got["a"].text == "fine" and got["a"].parser == "docx_parser" and got["a"].error is None
    assert all(got[n].text is None and (got[n].error or n == "g") for n in "bcdefg")
    assert "ZIP" in got["b"].hint and got["c"].hint.startswith("无法解析文件 c.docx：")


def test_a_body_too_large_is_refused():
    data = docx("<w:body>" + para("x" * 10_000) + "</w:body>")
    try:
        parse.read_docx(data, largest=5000)
    except ValueError as e:
        assert "5000" in str(e)
    else:
        raise AssertionError


def test_dispatch_by_suffix_and_parser(spark):
    rows = [
        ("a", ".json", b'{"title": "T"}'), ("b", ".json", b"{"), ("c", ".html", b"<p>x</p><script>y</script>z"), ("d", ".htm", b"<b>q</b>"), ("e", ".txt", "é".encode()), ("f", "", b"\xff bad"),
        ("g", ".pdf", b"%PDF"), ("h", ".png", b""), ("i", ".md", b"# t"),
    ]
    df = spark.createDataFrame([(n, s, f"dir/{n}{s}", c) for n, s, c in rows], "stem string, suffix string, path string, content binary")
    read = spark.createDataFrame([("dir/g.pdf", "ocr text", "own", "2")], "path string, text string, parser string, parser_version string")
    got = {r.stem: r for r in parse.parse_files(df, external=read).collect()}
    assert got["a"].text.startswith("T\n") and got["b"].error == "not valid JSON" and got["c"].text == "x\nz" and got["d"].text == "q" and got["e"].text == "é" and got["f"].text == "� bad"
    assert (got["g"].text, got["g"].parser, got["g"].parser_version) == ("ocr text", "own", "2") and "external" in got["h"].error and got["i"].text == "# t"
    plain = {r.stem: r.text for r in parse.parse_files(df, "plain").collect()}
    assert plain["c"].startswith("<p>") and plain["b"] == "{"
    forced = {r.stem: r.error for r in parse.parse_files(df, "docx").collect()}
    assert forced["e"] == "docx parser cannot parse .txt files" and forced["f"] == "docx parser cannot parse extensionless files"


def test_documents_and_quarantine(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "s1.html").write_text("<p>eins</p>")
    (raw / "s1.txt").write_text("other")
    (raw / "s1.meta.json").write_text("{}")
    (raw / "s2.docx").write_bytes(docx(f"<w:body>{para('zwei')}</w:body>"))
    (raw / "s3.docx").write_bytes(b"old")
    (raw / "s4.json").write_text('{"data": {"title": "vier", "content": {"children": "k"}}}')
    (raw / "stray.txt").write_text("nobody's")
    src = [(f"s{i}", f"title {i}", "u", "site", "law", f, ["tag"], None if i == 1 else "valid") for i, f in ((1, "HTML"), (2, "docx"), (3, "docx"), (4, "json"), (5, "txt"))]
    sources = spark.createDataFrame(src, "source_id string, title string, source_url string, source_site string, doc_type string, file_format string, topic_tags array<string>, law_status string")
    rows = parse.documents(sources, files.raw_files(spark, str(raw)), fetched_at=F.lit("now"))
    good, bad = parse.write_documents(rows, str(tmp_path / "out"))
    got = {r.doc_id: r for r in good.collect()}
    assert {i: r.text for i, r in got.items()} == {"s1": "eins", "s2": "zwei", "s4": "vier\n制定机关：\n公布日期：\n施行日期：\n法规类型：\nk"}
    assert got["s1"].raw_format == "html" and got["s1"].law_status == "unknown" and got["s2"].law_status == "valid" and got["s1"].legal_domain == [] and got["s1"].topic_tags == ["tag"]
    assert got["s2"].ingest_meta == ("now", "docx_parser", "0.1.0") and got["s2"].structure == [(["title 2"], "zwei")] and got["s1"].applicable_region == "CN"
    assert {r.source_id: r.error for r in bad.collect()} == {"s3": "DOCX parser received a non-zip document", "s5": "No raw file found for s5"}


def test_materials(spark):
    got = parse.pasted_materials(spark.createDataFrame([("a",), (" ",), (None,)], "text string")).collect()
    assert [(r.material_text, r.error is None) for r in got] == [("a", True), (None, False), (None, False)] and got[0].parser == "pasted_text"
    df = spark.createDataFrame([("n", ".txt", "/up/n.txt", b"text"), ("m", "", "/up/m", b" "), ("k", ".docx", "/up/k.docx", b"x")], "stem string, suffix string, path string, content binary")
    up = {r.title: r for r in parse.uploaded_materials(df).collect()}
    assert up["n"].source_id == "upload_n" and up["n"].material_text == "text" and up["n"].uploaded_file.raw_format == "txt" and up["n"].error is None
    assert up["m"].uploaded_file.raw_format == "txt" and up["m"].error == "material_text must not be blank" and "ZIP" in up["k"].hint


def test_hints(spark):
    rows = [("a.pdf", "Conversion failed"), ("a.png", "OCR gave nothing"), ("a.txt", "ocr"), ("a.bmp", "图片 转换为 PDF 以"), ("A.PDF", "other")]
    got = [r.h for r in spark.createDataFrame(rows, "n string, e string").select(parse.parse_hint(F.col("n"), F.col("e")).alias("h")).collect()]
    assert "密码保护" in got[0] and "扫描件" in got[1] and got[2] == "无法解析文件 a.txt：ocr" and "图片转 PDF 失败" in got[3] and got[4] == "无法解析文件 A.PDF：other"
