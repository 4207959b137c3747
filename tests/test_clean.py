from pyspark.sql import functions as F

from corpusloom.operators import clean as C


def test_simple_clean(spark):
    df = spark.createDataFrame([("a\r\nb \t\nc\x00\n\n\n\nd  ",)], "t string")
    assert df.select(C.simple_clean(F.col("t"))).first()[0] == "a\nb\nc\n\nd\n"


def test_lines_and_titles(spark):
    text = "T\nx\n T \n<!-- image -->\n|---|\nURL Source: q\n2024年 5 月\n[www.cac.gov.cn/a]\n[a cac.gov.cn b](c)\nsee cac.gov.cn"
    df = spark.createDataFrame([(text, "T")], "t string, title string")
    titles = df.select(C.drop_titles(F.col("t"), F.col("title")).alias("c")).first().c
    assert titles.n == 1 and titles.text == text.replace(" T \n", "")
    r = df.select(C.drop_lines(F.col("t")).alias("c")).first().c
    assert r.text == "T\nx\n T \nsee cac.gov.cn"
    assert r.rules == ["image_placeholder_lines", "table_divider_lines", "web_boilerplate_lines", "standalone_year_month_lines", "standalone_source_url_lines", "standalone_source_url_lines"]


def test_contents_of_chapters():
    assert C.remove_contents(["t", "目录", "第一章 甲", "第二章 乙", "第一章 甲", "正文"]) == (["t", "第一章 甲", "正文"], 3)
    body = ["目录", "第一章 总则", "body", "第二章 乙", "body", "see", "第一章 总则", "end"]
    assert C.remove_contents(body) == (body, 0)
    assert C.remove_contents(["no", "block"]) == (["no", "block"], 0)


def test_contents_of_entries():
    assert C.remove_contents(["contents", "a ...... 3", "12", "1 范围", "body"]) == (["1 范围", "body"], 3)
    assert C.remove_contents(["# 目 次", "", "a ...... 3", "|---|", "前言", "x"])[0] == ["前言", "x"]
    twice = ["目次", "a ....... 1", "前言", "b", "目次", "c ....... 2", "text"]
    assert C.remove_contents(twice) == (["前言", "b", "text"], 4)
    open_end = ["目次"] + ["a ...... 3"] * 80
    assert C.remove_contents(open_end) == (open_end, 0)
    assert C.remove_contents(["目次", "text", "a ...... 3"])[1] == 0


def test_numbers_and_letters():
    assert C.merge_numbers(["3.2", "## Title", "x"]) == (["3.2 Title", "x"], 1)
    assert C.merge_numbers(["3.2", "", "## Title", "x"]) == (["3.2 Title", "## Title", "x"], 1)
    assert C.merge_numbers(["3.2", "4", "x"]) == (["3.2", "4 x"], 1)
    assert C.join_spaced_letters("D a t a s e t; of a b c") == ("Dataset; of a b c", 1)


def test_documents(spark):
    text = "\x00t  \n目录\n第一章\n第一章\nt\nD a t a s e\n3\nx\n\n\n\ny\n<!-- image -->"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    rows = {r.doc_id: r for r in C.clean_documents(df, F.when(F.col("doc_id") == 1, "t")).collect()}
    assert rows[1].text == "t\n第一章\nDatase\n3 x\n\ny\n"
    assert rows[1].cleaning_rule_hits == {
        "control_chars": 1, "trailing_space": 1, "duplicate_title": 1, "contents_table_lines": 2, "image_placeholder_lines": 1, "spaced_latin": 1, "merged_isolated_numbers": 1, "blank_lines": 1,
    }
    assert rows[2].text == "\n" and rows[2].cleaning_rule_hits == {}


def test_every_mechanical_line_passes_the_first_look(spark):
    lines = [
        "<!-- image -->", "|---|", "Number of Pages: 3", "本文档可从以下网址获得：", "[x tc260.org.cn y](z)", "2021年 3月", "TECHNICAL COMMITTEE", "Cyber", "维化技术", "术委员会", "会", "委", "范围.......12", "a······IV", "Title: x", "URL Source: y",
        "Markdown Content:", "2021年03月04日 星期一", "[设为首页] [加入收藏]", "[搜索](x", "* ![Image 1", "![Image 2", "[![Image 3", "* ### [首页", "### 首页", "* [首页]", "当前位置：a", "[](b", "[【打印】]", "关闭", "中央网络安全和信息化委员会办公室", "中华人民共和国国家互联网信息办公室 © 版权所有",
        "承办：x", "技术支持：y", "京ICP备1号", "[京公网安备1", "Produced By CMS", "分享到微信", "打开微信", "使用“扫一扫”", "*  ###### 微信", "_◆_◆", "www.cac.gov.cn", "https://flk.npc.gov.cn/x", "(tc260.org.cn)", "[cac.gov.cn](x)", "flk.npc.gov.cn", "plain line", "第一条 文", "Contents",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", C.mechanical_rule(F.col("x")).alias("a"), C._first_rule(F.col("x")).alias("b"))
    rows = df.collect()
    assert all(r.a == r.b for r in rows) and sum(r.a is not None for r in rows) >= len(lines) - 5


def test_guards_let_through_what_the_rules_find(spark):
    texts = ["# 目 录\n第一章 x\n第一章 x\nbody", "Table of Contents\nA.....1\nB.....2\n1 范围", "t e x t x here", "3\n\ntitle", "1.2\n## head", "  4  \nx", "nothing here", "C O N T E N T S\nA ..... 1\nx", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", C.without_contents(F.col("t")).alias("c"), C.joined_lines(F.col("t")).alias("j"))
    for r in df.collect():
        lines, n = C.remove_contents(r.t.split("\n"))
        assert (r.c.text, r.c.contents_table_lines) == ("\n".join(lines), n)
        spaced = [C.join_spaced_letters(x) for x in r.t.split("\n")]
        merged, k = C.merge_numbers([x for x, _ in spaced])
        assert (r.j.text, r.j.spaced_latin, r.j.merged_isolated_numbers) == ("\n".join(merged), sum(m for _, m in spaced), k)
