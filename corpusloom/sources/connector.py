"""Answers of a law database's search, as they were stored, to source rows; manifests of sources.

Offline: answers are rows of (term_pos, term, payload), the payload the JSON of an answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import html_to_text

#: Words in a kind of law and what they mean, in order; status codes; keys that may hold the issuing body.
DOC_TYPES = {("法律",): "law", ("法规", "条例"): "regulation", ("解释",): "guideline"}
AUTHORITIES = {"法律": "national_law", "行政法规": "administrative_regulation", "司法解释": "judicial_interpretation", "地方": "local_regulation"}
STATUSES = {3: "effective", 2: "amended", 1: "repealed"}
ISSUERS = ("zdjg", "zdjgName", "bbr", "gbr", "office")
DOMAIN = "数据合规"

_ROW = "struct<bbbs:string,title:string,xgzlHighLight:string,flxz:string,sxx:int,gbrq:string,sxrq:string,zdjg:string,zdjgName:string,bbr:string,gbr:string,office:string>"


def doc_type(kind: Column) -> Column:
    value = F.coalesce(kind, F.lit(""))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(value, w))
    return F.coalesce(*[F.when(has(words), F.lit(t)) for words, t in DOC_TYPES.items()], F.lit("policy"))


def authority(kind: Column) -> Column:
    value = F.coalesce(kind, F.lit(""))
    return F.coalesce(*[F.when(F.contains(value, F.lit(w)), F.lit(a)) for w, a in AUTHORITIES.items()], F.lit("unknown"))


def law_status(code: Column) -> Column:
    return F.coalesce(*[F.when(code == c, F.lit(s)) for c, s in STATUSES.items()], F.lit("unknown"))


def search_sources(answers: DataFrame, site: str, prefix: str, detail_url: str, download_url: str) -> DataFrame:
    """Source rows of stored answers, one for each document id, in the order in which ids first came; the last answer's values hold.

    A row counts if its term is in its title or its highlight. An answer that is no JSON, or whose code isn't 200, is an error.
    """
    told = F.from_json("payload", f"struct<code:int,msg:string,rows:array<{_ROW}>>")
    good = F.assert_true(F.coalesce(told["code"] == 200, F.lit(False)), F.concat(F.lit("search failed for "), F.col("term")))
    rows = answers.select("term_pos", "term", F.when(good.isNull(), told["rows"]).alias("rows")).select("term_pos", "term", F.posexplode("rows").alias("row_pos", "r")).select("term_pos", "term", "row_pos", "r.*")
    rows = rows.withColumn("title", html_to_text(F.coalesce("title", F.lit("")))).where((F.coalesce("bbbs", F.lit("")) != "") & (F.col("title") != ""))
    rows = rows.where(F.contains("title", F.col("term")) | F.contains(F.coalesce("xgzlHighLight", F.lit("")), F.col("term")))
    place = F.struct("term_pos", "row_pos")
    once = rows.groupBy("bbbs").agg(F.min(place).alias("_first"), F.max_by(F.struct(*[c for c in rows.columns if c != "bbbs"]), place).alias("r")).select("bbbs", "_first", "r.*")
    issuer = F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", html_to_text(F.col(c))) for c in ISSUERS])
    return once.select(
        F.concat(F.lit(prefix), "bbbs").alias("source_id"), "title", F.concat(F.lit(f"{detail_url}?bbbs="), "bbbs").alias("source_url"), F.concat(F.lit(f"{download_url}?format=docx&bbbs="), "bbbs").alias("download_url"),
        F.lit(site).alias("source_site"), doc_type(F.col("flxz")).alias("doc_type"), authority(F.col("flxz")).alias("authority"), law_status(F.col("sxx")).alias("law_status"), F.col("gbrq").alias("publish_date"),
        F.col("sxrq").alias("effective_date"), issuer.alias("issuing_body"), F.lit("CN").alias("applicable_region"), F.array(F.lit(DOMAIN)).alias("legal_domain"), F.array().cast("array<string>").alias("applicable_subjects"),
        F.array("term", F.lit(DOMAIN)).alias("topic_tags"), F.lit("zh").alias("language"), F.lit("docx").alias("file_format"), F.lit(True).alias("include_in_mvp"), F.col("_first").alias("position"),
    )


def document_id(source_id: Column, prefix: str) -> Column:
    """The database's id in a source's id; an id of elsewhere is an error."""
    own = F.startswith(source_id, F.lit(prefix))
    return F.when(F.assert_true(own, F.concat(F.lit("not an id of this database: "), source_id)).isNull(), F.substring(source_id, F.lit(len(prefix) + 1), F.length(source_id)))


def seed_manifest(seeds: DataFrame, topic: str, limit: int | None = None) -> DataFrame:
    """The seeds (with topic and position) of a topic in order, at most ``limit``; a topic without any is an error."""
    own = seeds.where(F.col("topic") == topic)
    if own.isEmpty():
        raise ValueError(f"unsupported topic {topic}")
    place = own.withColumn("_n", F.row_number().over(Window.partitionBy("topic").orderBy("position", "source_id")))
    return (place.where(F.col("_n") <= limit) if limit else place).drop("_n")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """n_total and n_included of a manifest."""
    return manifest.agg(F.count("*").alias("n_total"), F.count_if(F.coalesce("include_in_mvp", F.lit(False))).alias("n_included"))
