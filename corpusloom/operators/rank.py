"""Ranking algebra: multi-query merge, boosts, rank fusion, source-aware collapse, rerank, context.

Hits are rows of case_id, chunk_id, source_id and score; ranks are zero-based and every order
ends in a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import contains_any, jaccard


def ranked(hits: DataFrame, order: list, k: int | None = None, by: str = "case_id") -> DataFrame:
    """hits with zero-based ranks by group; the cut comes before the subtraction, so that Spark takes it to the map side."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return (out if k is None else out.where(F.col("rank") <= k)).withColumn("rank", F.col("rank") - 1)


def merge_queries(hits: DataFrame, k: int) -> DataFrame:
    """Best score of a chunk over a case's queries (the first query wins ties), then the k best."""
    first = Window.partitionBy("case_id", "chunk_id").orderBy(F.desc("score"), "query_pos")
    best = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return ranked(best, [F.desc("score"), "chunk_id"], k)


def region_code(region: Column) -> Column:
    """Exact name, else the first name contained, else the text itself."""
    exact = F.coalesce(*[F.when(region == n, F.lit(c)) for n, c in rules.REGION_CODES.items()])
    part = F.coalesce(*[F.when(F.contains(region, F.lit(n)), F.lit(c)) for n, c in rules.REGION_CODES.items()])
    return F.coalesce(exact, part, region)


def region_matches(own: Column, wanted: Column) -> Column:
    """Equal, or one is the other's parent."""
    return F.coalesce((own == wanted) | F.startswith(own, F.concat(wanted, F.lit("-"))) | F.startswith(wanted, F.concat(own, F.lit("-"))), F.lit(False)) & ~F.coalesce(
        own.isin(*rules.NOT_LOCAL), F.lit(True)
    )


def specific_region(code: Column) -> Column:
    return F.coalesce(~code.isin(*rules.NOT_LOCAL), F.lit(False))


def industry_matches(words: Column, industry: Column, table: dict[str, tuple[str, ...]] | None = None) -> Column:
    table = table or rules.INDUSTRY_WORDS
    known = F.coalesce(*[F.when(industry == i, contains_any(words, w)) for i, w in table.items()])
    return F.coalesce(known, F.contains(words, industry), F.lit(False))


def boost_factor(cross_border_terms: tuple[str, ...] = rules.BOOST_CROSS_BORDER_TERMS, industries: dict[str, tuple[str, ...]] | None = None, regions: Column | None = None) -> Column:
    """Product of the boosts of a hit joined to its chunk and its case's facts.

    Columns: citation_role, primary_like, mentions (title, beginning and tags), applicable_region,
    subject_words, query_type, and of the facts cross_border, region, industry.
    """
    b = rules.BOOSTS
    role = F.col("citation_role")
    code = regions if regions is not None else region_code(F.col("region"))
    one = F.lit(1.0)
    cross = F.coalesce("cross_border", F.lit(False)) & contains_any(F.col("mentions"), cross_border_terms)
    primary = F.when(F.col("primary_like"), F.when(cross, F.lit(b["primary"]) * b["primary_cross_border"]).otherwise(b["primary"])).otherwise(one)
    local = F.when(
        (role == "conditional_local_basis") & F.col("region").isNotNull(),
        F.when(region_matches(F.col("applicable_region"), code), F.lit(b["local"])).when(specific_region(code), F.lit(b["local_mismatch"])).otherwise(one),
    ).otherwise(one)
    industry = F.when(
        (role == "conditional_industry_basis") & F.col("industry").isNotNull(),
        F.when(industry_matches(F.col("subject_words"), F.col("industry"), industries), F.lit(b["industry"]))
        .when(~F.lower(F.trim("industry")).isin(*rules.NO_INDUSTRY), F.lit(b["industry_mismatch"]))
        .otherwise(one),
    ).otherwise(one)
    asked = F.coalesce(F.col("query_type") == "missing_information", F.lit(False))
    implementation = F.when((role == "implementation_reference") & asked, F.lit(b["implementation"])).otherwise(one)
    auxiliary = F.when(role == "interpretation_auxiliary", F.lit(b["auxiliary"])).otherwise(one)
    missing = F.when(asked, F.lit(b["missing_information"])).otherwise(one)
    return primary * local * industry * implementation * auxiliary * missing


def boost_summary(facts: DataFrame, query_types: DataFrame) -> DataFrame:
    """case_id, boosts (map): the boost rules that a case's facts and query types (case_id, query_type) set going."""
    b = rules.BOOSTS
    asked = query_types.groupBy("case_id").agg(F.bool_or(F.col("query_type") == "missing_information").alias("asked"))
    code = region_code(F.col("region"))
    entry = lambda when, key, value: F.when(when, F.struct(key.alias("key"), F.lit(value).alias("value")))
    named = F.coalesce(~F.lower(F.trim("industry")).isin(*rules.NO_INDUSTRY), F.lit(False))
    entries = F.array(
        entry(F.lit(True), F.lit("primary_legal_basis"), b["primary"]),
        entry(F.lit(True), F.lit("interpretation_auxiliary"), b["auxiliary"]),
        entry(F.coalesce("cross_border", F.lit(False)), F.lit("primary_legal_basis:cross_border"), b["primary_cross_border"]),
        entry(F.col("region") != "", F.concat(F.lit("conditional_local_basis:"), code), b["local"]),
        entry((F.col("region") != "") & specific_region(code), F.lit("conditional_local_basis:mismatch"), b["local_mismatch"]),
        entry(F.col("industry") != "", F.concat(F.lit("conditional_industry_basis:"), "industry"), b["industry"]),
        entry((F.col("industry") != "") & named, F.lit("conditional_industry_basis:mismatch"), b["industry_mismatch"]),
        entry(F.coalesce("asked", F.lit(False)), F.lit("implementation_reference:missing_information"), b["implementation"]),
        entry(F.coalesce("asked", F.lit(False)), F.lit("query_type:missing_information"), b["missing_information"]),
    )
    return facts.join(asked, "case_id", "left").select("case_id", F.map_from_entries(F.array_compact(entries)).alias("boosts"))


def apply_boosts(hits: DataFrame, chunks: DataFrame, facts: DataFrame, **options) -> DataFrame:
    """hits with boost, and scores times it, rounded to 6 places; a hit without a chunk passes unchanged. options: as of boost_factor."""
    own = hits.join(chunks, "chunk_id", "left").join(facts, "case_id", "left")
    factor = F.when(F.col("mentions").isNull(), F.lit(1.0)).otherwise(boost_factor(**options))
    return own.withColumn("boost", factor).withColumn("score", F.round(F.col("score") * F.col("boost") + 1e-9, 6)).select(*hits.columns, "boost")


def rrf(hits: DataFrame, k: int, constant: int = rules.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of any number of lists (list_id); lists are ranked anew by score, zero-based.

    A chunk that a list holds twice counts once, at its best place.
    """
    once = Window.partitionBy("case_id", "list_id", "chunk_id").orderBy(F.desc("score"))
    hits = hits.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    place = Window.partitionBy("case_id", "list_id").orderBy(F.desc("score"), "chunk_id")
    placed = hits.withColumn("_r", F.row_number().over(place) - 1)
    fused = placed.groupBy("case_id", "chunk_id").agg(
        F.sum(1.0 / (constant + F.col("_r"))).alias("_s"), F.min_by("source_id", "list_id").alias("source_id"), F.count("*").alias("n_lists")
    )
    out = ranked(fused.withColumn("_s", F.round("_s", 12)), [F.desc("_s"), "chunk_id"], k)
    return out.withColumn("score", F.round("_s", 6)).drop("_s")


def source_fuse(hits: DataFrame, chunks: DataFrame, k: int, near: float = rules.NEAR_DUPLICATE) -> DataFrame:
    """One row per source: its best chunk, plus up to two supports that aren't near-duplicates of it.

    chunks: chunk_id, tokens (array), chunk_index, article_no, prev_chunk_id, next_chunk_id. A support
    of the representative's article, before or after it, or within one place of it decays less.
    """
    inside = Window.partitionBy("case_id", "source_id").orderBy(F.desc("score"), "rank", "chunk_id")
    place = ["tokens", "chunk_index", "article_no", "prev_chunk_id", "next_chunk_id"]
    own = hits.join(chunks.select("chunk_id", *place), "chunk_id", "left")
    placed = own.withColumn("_p", F.row_number().over(inside))
    rep = placed.where("_p = 1").select("case_id", "source_id", "chunk_id", "query_type", F.col("score").alias("rep_score"), *[F.col(c).alias(f"rep_{c}") for c in place])
    rest = placed.where("_p > 1").select("case_id", "source_id", F.col("chunk_id").alias("sup"), F.col("score").alias("s"), *place, "_p").join(
        rep.drop("query_type", "rep_score"), ["case_id", "source_id"]
    )
    rest = rest.where(jaccard(F.col("rep_tokens"), F.col("tokens")) < near)
    support = Window.partitionBy("case_id", "source_id").orderBy("_p")
    rest = rest.withColumn("_n", F.row_number().over(support)).where("_n <= 2")
    related = F.lit(False)
    for met in (
        (F.col("article_no") == F.col("rep_article_no")) & (F.col("article_no") != ""),
        F.col("rep_next_chunk_id") == F.col("sup"),
        F.col("rep_prev_chunk_id") == F.col("sup"),
        F.col("next_chunk_id") == F.col("chunk_id"),
        F.col("prev_chunk_id") == F.col("chunk_id"),
        F.abs(F.col("chunk_index") - F.col("rep_chunk_index")) <= 1,
    ):
        related = related | F.coalesce(met, F.lit(False))
    decay = F.when(related, F.lit(rules.CONTEXT_DECAY)).otherwise(rules.SUPPORT_DECAY)
    added = rest.groupBy("case_id", "source_id").agg(F.sum(F.col("s") * decay).alias("added"), F.count("*").alias("n_supports"))
    weight = F.coalesce(*[F.when(F.col("query_type") == t, F.lit(w)) for t, w in rules.QUERY_TYPE_WEIGHTS.items()], F.lit(1.0))
    total = (F.col("rep_score") + F.coalesce("added", F.lit(0.0))) * weight
    out = rep.join(added, ["case_id", "source_id"], "left").withColumn("score", F.round(total, 6))
    return ranked(out, [F.desc("score"), "source_id"], k).select("case_id", "source_id", "chunk_id", "score", F.coalesce("n_supports", F.lit(0)).alias("n_supports"), "rank")


def rerank(hits: DataFrame, scores: DataFrame, k: int, window: int = 50, weight: float = 0.4) -> DataFrame:
    """Blend of min-max normalised scores over the first places; the tail follows unchanged."""
    span = F.greatest(F.lit(k), F.lit(window))
    own = hits.join(scores, ["case_id", "chunk_id"], "left").withColumn("_head", F.col("rank") < span)
    over = Window.partitionBy("case_id", "_head")

    def unit(c: str) -> Column:
        low, high = F.min(c).over(over), F.max(c).over(over)
        return F.when(F.col(c).isNull(), F.lit(0.0)).when(high == low, F.lit(1.0)).otherwise((F.col(c) - low) / (high - low))

    blend = F.when(F.col("_head"), F.round((1 - weight) * unit("score") + weight * unit("rerank_score"), 6)).otherwise(F.col("score"))
    out = own.withColumn("final", blend).withColumn("_old", F.col("rank"))
    out = ranked(out, [F.desc("_head"), F.when(F.col("_head"), -F.col("final")).otherwise(F.lit(0.0)), "_old"], k)
    return out.select("case_id", "chunk_id", F.col("final").alias("score"), "rank")


#: The parts of a text for a reranker, and its lengths.
RERANK_QUERY, RERANK_DOCUMENT, RERANK_MATERIAL, RERANK_PARTS = 1200, 1400, 500, 6


def rerank_query() -> Column:
    """The query text for a reranker, of a case's question, text (material), facts and queries (array of texts)."""
    named = lambda label, c: F.when(F.coalesce(F.col(c).cast("string") != "", F.lit(False)), F.concat(F.lit(label), F.col(c).cast("string")))
    abroad = F.when(F.col("cross_border_transfer").isNotNull(), F.concat(F.lit("跨境传输="), F.initcap(F.col("cross_border_transfer").cast("string"))))
    kinds = F.when(F.size("data_types") > 0, F.concat(F.lit("数据类型="), F.array_join(F.slice("data_types", 1, RERANK_PARTS), ",")))
    facts = F.concat_ws("；", abroad, named("地区=", "region"), named("行业=", "industry"), kinds)
    asked = F.array_join(F.slice("queries", 1, RERANK_PARTS), "；")
    material = F.trim("text")
    parts = F.concat_ws(
        "\n", F.concat(F.lit("用户问题："), F.trim("question")), F.concat(F.lit("业务事实："), F.when(facts == "", "无明确结构化事实").otherwise(facts)),
        F.when(asked != "", F.concat(F.lit("检索意图："), asked)), F.when(material != "", F.concat(F.lit("材料摘要："), F.substring(material, 1, RERANK_MATERIAL))),
    )
    return F.substring(parts, 1, RERANK_QUERY)


def rerank_document() -> Column:
    """The document text for a reranker, of a hit's title, citation_role, query_type and text."""
    parts = F.concat(F.lit("标题："), "title", F.lit("\n证据角色："), "citation_role", F.lit("\n查询类型："), F.coalesce("query_type", F.lit("unknown")), F.lit("\n正文："), "text")
    return F.substring(parts, 1, RERANK_DOCUMENT)


def expand_neighbors(top: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """Chunks before and after the top hits, in hit order, each once, none of the top, at most ``most``; score 0."""
    sides = top.join(chunks.select("chunk_id", "prev_chunk_id", "next_chunk_id"), "chunk_id").select(
        "case_id", F.col("rank").alias("hit_pos"), F.posexplode(F.array("prev_chunk_id", "next_chunk_id")).alias("side", "chunk_id")
    )
    sides = sides.where("chunk_id is not null").join(top.select("case_id", "chunk_id"), ["case_id", "chunk_id"], "left_anti")
    seen = Window.partitionBy("case_id", "chunk_id").orderBy("hit_pos", "side")
    sides = sides.withColumn("_n", F.row_number().over(seen)).where("_n = 1")
    return ranked(sides, ["hit_pos", "side"], most).select("case_id", "chunk_id", (-(F.col("side") + 1)).alias("side"), F.lit(0.0).alias("score"), F.col("rank").alias("pos"))


def source_packets(final: DataFrame, candidates: DataFrame, supports: int = 2, neighbors: DataFrame | None = None) -> DataFrame:
    """case_id, source_id, representative, supporting and neighbors (arrays of chunk ids in order), rank.

    ``neighbors``: case_id, source_id, chunk_id, pos, as of expand_neighbors; they go to the packet of their source.
    """
    reps = final.select("case_id", "source_id", F.col("chunk_id").alias("_rep"))
    kind = f"array<{final.schema['chunk_id'].dataType.simpleString()}>"
    rest = candidates.join(reps, ["case_id", "source_id"]).where("chunk_id <> _rep")
    place = Window.partitionBy("case_id", "source_id", "_rep").orderBy("rank", F.desc("score"), "chunk_id")
    rest = rest.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= supports)
    listed = rest.groupBy("case_id", "source_id", "_rep").agg(F.sort_array(F.collect_list(F.struct("_n", "chunk_id"))).alias("s"))
    keys = ["case_id", "source_id", "_rep"]
    out = final.withColumn("_rep", F.col("chunk_id")).join(listed, keys, "left")
    if neighbors is None:
        near = F.array().cast(kind)
    else:  # at most as many as expand_neighbors gives a case
        own = neighbors.join(reps, ["case_id", "source_id"]).where("chunk_id <> _rep")
        out = out.join(own.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))).alias("n")), keys, "left")
        near = F.coalesce(F.col("n.chunk_id"), F.array().cast(kind))
    return out.select("case_id", "source_id", F.col("chunk_id").alias("representative"), F.coalesce(F.col("s.chunk_id"), F.array().cast(kind)).alias("supporting"), near.alias("neighbors"), "rank")


def flatten_packets(packets: DataFrame) -> DataFrame:
    """Representatives, supports and neighbours in packet order, each chunk once."""
    every = packets.select("case_id", "rank", F.posexplode(F.concat(F.array("representative"), "supporting", "neighbors")).alias("i", "chunk_id"))
    first = Window.partitionBy("case_id", "chunk_id").orderBy("rank", "i")
    once = every.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumnRenamed("rank", "packet")
    return ranked(once, ["packet", "i"]).select("case_id", "chunk_id", F.col("rank").alias("pos"))
