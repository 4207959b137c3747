"""Raw files to documents: one pass that routes every file to the parser of its kind, with failures as rows.

JSON, HTML and plain text are column expressions. DOCX files, zip archives of XML, are read in Arrow tasks; other
files give that step a null, so only their bytes pass through it. Kinds that need an external parser
(PDF, images) take its text from a table by path, and are quarantined without one. A file that can't be
parsed is a row with its error and a hint for the user, and never stops the others.
"""

from __future__ import annotations

import zipfile
from html import escape
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.json_text import json_to_text
from corpusloom.functions.text import html_to_text, strip_ws

#: Suffixes that need an external parser, parser names with their version, the XML name space of DOCX files.
EXTERNAL = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
PARSERS = {"json": "json_parser", "docx": "docx_parser", "html": "html_text_parser", "plain": "plain_text_parser"}
VERSION = "0.1.0"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

#: Bytes that the body of one DOCX file may expand to; a larger one is quarantined.
LARGEST_BODY = 1 << 28

#: Columns that a source row may hold besides its own, with what stands where they are missing or null.
DEFAULTS = {
    "download_url": None, "authority": "unknown", "law_status": "unknown", "publish_date": None, "effective_date": None, "issuing_body": None, "language": "zh",
    "applicable_region": "CN", "case_no": None, "court": None, "trial_instance": None, "clause_type": None,
}
LISTS = ("legal_domain", "applicable_subjects", "contract_parties", "topic_tags")


class _Body:
    """Blocks of a DOCX body as they are closed; each is dropped from the tree at once."""

    def __init__(self, xml) -> None:
        self.blocks: list[str] = []
        parents: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(xml, ("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if len(parents) == 2 and parents[-1].tag == f"{WORD}body":  # document, body
                self._add(element)
                parents[-1].clear()

    def _add(self, block: ElementTree.Element) -> None:
        text = _words(block) if block.tag == f"{WORD}p" else _table(block) if block.tag == f"{WORD}tbl" else ""
        if text:
            self.blocks.append(text)


def _words(paragraph: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in paragraph.iter(f"{WORD}t")).strip()


def _table(table: ElementTree.Element) -> str:
    rows = []
    for row in table.findall(f"{WORD}tr"):
        cells = [escape("\n".join(filter(None, map(_words, cell.findall(f"{WORD}p"))))) for cell in row.findall(f"{WORD}tc")]
        if cells:
            rows.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>")
    return f"<table>{''.join(rows)}</table>" if rows else ""


def read_docx(content: bytes, largest: int = LARGEST_BODY) -> str:
    """Paragraphs and tables in body order, a line each; tables as HTML."""
    if not content.startswith(b"PK\x03\x04"):
        raise ValueError("DOCX parser received a non-zip document")
    with zipfile.ZipFile(BytesIO(content)) as archive:
        if archive.getinfo("word/document.xml").file_size > largest:
            raise ValueError(f"DOCX body expands to more than {largest} bytes")
        with archive.open("word/document.xml") as xml:
            return "\n".join(_Body(xml).blocks)


def docx_to_text(content: Column) -> Column:
    """struct(text, error) of DOCX bytes; both null for null."""

    @F.pandas_udf("struct<text:string,error:string>")
    def parsed(raw: pd.Series) -> pd.DataFrame:
        out = []
        for c in raw:
            try:
                out.append((None, None) if c is None else (read_docx(c), None))
            except Exception as e:  # whatever a file holds, it is a row
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["text", "error"])

    return parsed(content)


def kind_of(suffix: Column, parser: str = "auto") -> Column:
    """json, docx, html, external or plain."""
    if parser in ("plain", "docx"):
        return F.lit(parser)
    if parser != "auto":
        raise ValueError(f"unknown parser {parser}")
    return F.when(suffix == ".json", "json").when(suffix == ".docx", "docx").when(suffix.isin(".html", ".htm"), "html").when(suffix.isin(*EXTERNAL), "external").otherwise("plain")


def parse_hint(name: Column, error: Column) -> Column:
    """What a user is told of a file that can't be parsed. The sentences are fixed values."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    low = F.lower(error)
    has = lambda *terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
    return (
        F.when(has("non-zip"), F.concat(name, F.lit(" 不是有效的 DOCX 文件（ZIP 头校验失败），可能是旧版 .doc 或损坏文件，请另存为 .docx 后重试。")))
        .when(has("转换为 pdf"), F.concat(name, F.lit(" 无法解析：图片转 PDF 失败（"), error, F.lit("）。请确认图片未损坏，或直接提供 PDF 文档。")))
        .when(
            suffix.isin(*EXTERNAL) & has("could not load document", "data format error", "conversion failed", "is not valid"),
            F.concat(name, F.lit(" 无法加载：文件为空、损坏或受密码保护。请确认文件可正常打开后重新上传。")),
        )
        .when(suffix.isin(*EXTERNAL) & has("ocr"), F.concat(name, F.lit(" 解析后未提取到有效文本，可能是扫描件且 OCR 识别失败。请提供可选择文本的文档，或提升扫描清晰度后重试。")))
        .otherwise(F.concat(F.lit("无法解析文件 "), name, F.lit("："), error))
    )


def parse_files(files: DataFrame, parser: str = "auto", external: DataFrame | None = None) -> DataFrame:
    """files (suffix, path, content) with text, parser, parser_version, and error and hint where text is null.

    ``external``: path, text, parser, parser_version of what an external parser has read.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("_kind", kind_of(F.col("suffix"), parser))
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    wrong = (F.col("_kind") == "docx") & (F.col("suffix") != ".docx")  # only if the parser is given
    rows = rows.withColumn("_docx", docx_to_text(F.when((F.col("_kind") == "docx") & ~wrong, F.col("content"))))
    if external is not None:
        rows = rows.join(external.select("path", F.struct(F.col("text"), "parser", "parser_version").alias("_external")), "path", "left")
    else:
        rows = rows.withColumn("_external", F.lit(None).cast("struct<text:string,parser:string,parser_version:string>"))
    text = (
        F.when(F.col("_kind") == "json", json_to_text(raw)).when(F.col("_kind") == "docx", F.col("_docx.text")).when(F.col("_kind") == "html", html_to_text(raw))
        .when(F.col("_kind") == "external", F.col("_external.text")).otherwise(raw)
    )
    error = (
        F.when(wrong, F.concat(F.lit("docx parser cannot parse "), F.when(F.col("suffix") == "", "extensionless").otherwise(F.col("suffix")), F.lit(" files")))
        .when(F.col("_kind") == "json", "not valid JSON").when(F.col("_kind") == "docx", F.col("_docx.error"))
        .when(F.col("_kind") == "external", F.concat(F.lit("an external parser is needed for "), F.col("suffix"))).otherwise("no content")
    )
    rows = rows.withColumn("text", text)
    named = F.create_map(*[F.lit(x) for pair in PARSERS.items() for x in pair])
    rows = rows.withColumn("error", F.when(F.col("text").isNull(), error)).withColumn("hint", F.when(F.col("text").isNull(), parse_hint(name, F.col("error"))))
    return rows.withColumns({
        "parser": F.coalesce(F.when(F.col("_kind") == "external", F.col("_external.parser")), named[F.col("_kind")]),
        "parser_version": F.when(F.col("_kind") == "external", F.col("_external.parser_version")).otherwise(VERSION),
    }).drop("_kind", "_docx", "_external")


def file_of(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Every source with the struct ``file`` (path, suffix) that belongs to it: of the declared format if there is one, else the first by path."""
    places = files.select("stem", F.struct("path", "suffix").alias("file"))
    both = sources.join(places, sources["source_id"] == places["stem"], "left").drop("stem")
    declared = F.concat(F.lit("."), F.ltrim(F.lower("file_format"), F.lit(".")))
    order = Window.partitionBy("source_id").orderBy(F.desc(F.coalesce(F.col("file.suffix") == declared, F.lit(False))), "file.path")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def documents(sources: DataFrame, files: DataFrame, parser: str = "auto", external: DataFrame | None = None, fetched_at: Column | None = None) -> DataFrame:
    """A row a source: the document's columns with parser lineage in ``ingest_meta``, ``outcome`` (document or quarantined), error and hint.

    Files are chosen by name; only the chosen ones are parsed.
    """
    known = sources.columns
    full = sources.withColumns({c: F.lit(v).cast("string") for c, v in DEFAULTS.items() if c not in known})
    full = full.withColumns({c: F.array().cast("array<string>") for c in LISTS if c not in known})
    if "file_format" not in known:
        full = full.withColumn("file_format", F.lit("html"))
    chosen = file_of(full, files).select(F.struct("*").alias("_source"), F.col("file.path").alias("path"), F.col("file.suffix").alias("suffix"))
    read = parse_files(chosen.join(files.select("path", "content"), "path", "left"), parser, external)
    rows = read.select("_source.*", F.struct("text", "parser", "parser_version", "error", "hint").alias("_read"))
    missing = F.col("file.path").isNull()
    error = F.when(missing, F.concat(F.lit("No raw file found for "), F.col("source_id"))).otherwise(F.col("_read.error"))
    hint = F.when(missing, F.concat(F.lit("无法解析文件 "), F.col("source_id"), F.lit("："), error)).otherwise(F.col("_read.hint"))
    suffix = F.ltrim(F.col("file.suffix"), F.lit("."))
    return rows.select(
        F.col("source_id").alias("doc_id"), "source_id", "title", "source_url", "source_site", "doc_type",
        *[(F.coalesce(F.col(c), F.lit(v)) if v is not None else F.col(c)).alias(c) for c, v in DEFAULTS.items()],
        *[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in LISTS],
        F.when(F.coalesce(suffix, F.lit("")) == "", F.col("file_format")).otherwise(suffix).alias("raw_format"),
        F.col("_read.text").alias("text"),
        F.when(F.col("_read.text").isNotNull(), F.array(F.struct(F.array("title").alias("heading_path"), strip_ws(F.col("_read.text")).alias("text")))).alias("structure"),
        F.struct((fetched_at if fetched_at is not None else F.current_timestamp()).alias("fetched_at"), F.col("_read.parser").alias("parser"), F.col("_read.parser_version").alias("parser_version")).alias("ingest_meta"),
        F.when(F.col("_read.text").isNotNull(), "document").otherwise("quarantined").alias("outcome"),
        error.alias("error"), hint.alias("hint"),
    )


def write_documents(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """One pass writes both outcomes below ``path``; (documents, quarantined) as they are read back."""
    rows.write.mode("overwrite").partitionBy("outcome").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    good = back.where("outcome = 'document'").drop("outcome", "error", "hint")
    bad = back.where("outcome = 'quarantined'").select("source_id", "raw_format", "error", "hint")
    return good, bad


def pasted_materials(texts: DataFrame, text: str = "text") -> DataFrame:
    """Materials of pasted texts; a blank one is a row with an error."""
    blank = strip_ws(F.coalesce(F.col(text), F.lit(""))) == ""
    return texts.select(
        "*", F.lit("pasted_text").alias("input_mode"), F.when(~blank, F.col(text)).alias("material_text"), F.lit(None).cast("string").alias("source_name"), F.lit("pasted_text").alias("parser"),
        F.lit(VERSION).alias("parser_version"), F.when(blank, "material_text must not be blank").alias("error"),
    )


def uploaded_materials(files: DataFrame, parser: str = "auto", external: DataFrame | None = None) -> DataFrame:
    """Materials of uploaded files, titled by their stems; a file without text is a row with an error and a hint."""
    rows = parse_files(files, parser, external)
    name = F.element_at(F.split("path", "/"), -1)
    blank = strip_ws(F.coalesce(F.col("text"), F.lit(""))) == ""
    raw_format = F.when(F.col("suffix") == "", "txt").otherwise(F.ltrim("suffix", F.lit(".")))
    error = F.coalesce(F.col("error"), F.when(blank, "material_text must not be blank"))
    return rows.select(
        F.concat(F.lit("upload_"), F.col("stem")).alias("source_id"), F.col("stem").alias("title"), F.lit("uploaded_file").alias("input_mode"), F.when(~blank, F.col("text")).alias("material_text"),
        name.alias("source_name"), "parser", "parser_version", F.struct(name.alias("filename"), F.col("path").alias("local_path"), raw_format.alias("raw_format")).alias("uploaded_file"),
        error.alias("error"), F.coalesce(F.col("hint"), F.when(error.isNotNull(), parse_hint(name, error))).alias("hint"),
    )
