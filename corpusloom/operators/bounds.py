"""Exact top-k over an index with upper bounds: frequent tokens don't meet every query.

The index is a table of postings (field, token, chunk_id, impact), each in a band of its impact, and one of bands
with the highest impact of each token and band and the number of its postings. A query is a set of
terms (field, token) with weights in groups; a group's score is the sum of weight * impact over its
terms that a chunk has, and a query's score the largest of its groups (or of the only one: a sum).

1. Rare terms of each query give a few seed chunks; their exact k-th best score is a floor that the k-th best
   of all chunks can't be under.
2. A group's bands are taken in ascending order of what they can add at most. Those that together
   can't reach the floor are never looked at for candidates: a chunk that has nothing but them isn't
   among the best. Chunks with any other band are candidates, if what they have there and the
   bound of the rest reach the floor.
3. Candidates meet their own postings, and only the query's terms among these, for exact scores.

So a band is read for a query only where it may decide, whatever the number of chunks that have it, and
the result is that of scoring all pairs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import token_set, tokens
from corpusloom.storage import materialize

#: Impacts of a token within a factor of this are one band, down to the last one.
BAND_STEP, BANDS = 1.3, 12

#: Seeds looked at for each query, as a multiple of k, and bounds that floats may be off.
SEEDS, SLACK = 4, 1e-6


class Index(NamedTuple):
    postings: DataFrame
    bands: DataFrame


def _banded(impacts: DataFrame) -> Index:
    """The tables of an index from field, token, chunk_id, impact."""
    top = impacts.groupBy("field", "token").agg(F.max("impact").alias("token_top"))
    step = F.floor(F.log(F.col("token_top") / F.col("impact")) / math.log(BAND_STEP)).cast("int")
    rows = impacts.join(top, ["field", "token"]).select("field", "token", F.least(step, F.lit(BANDS - 1)).alias("band"), "chunk_id", "impact")
    rows = materialize(rows, "postings")
    return Index(rows, materialize(rows.groupBy("field", "token", "band").agg(F.max("impact").alias("top"), F.count("*").alias("n")), "posting-bands"))


def exploded(corpus: DataFrame, fields: dict[str, str], split) -> DataFrame:
    """chunk_id, field, t of all fields in one pass over the corpus."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), split(F.coalesce(F.col(column), F.lit(""))).alias("t")) for name, column in fields.items()])
    return corpus.select("chunk_id", F.explode(each).alias("x")).select("chunk_id", "x.field", "x.t")


def share_index(corpus: DataFrame, fields: dict[str, str]) -> Index:
    """Distinct tokens of every field (name: column), all of impact 1."""
    rows = exploded(corpus, fields, token_set).select("field", F.explode("t").alias("token"), F.lit(0).alias("band"), "chunk_id", F.lit(1.0).alias("impact"))
    rows = materialize(rows, "postings")
    return Index(rows, materialize(rows.groupBy("field", "token").agg(F.count("*").alias("n")).select("field", "token", F.lit(0).alias("band"), F.lit(1.0).alias("top"), "n"), "posting-bands"))


def bm25_index(corpus: DataFrame, fields: dict[str, str], k1: float = 1.2, b: float = 0.75) -> Index:
    """An index of BM25 impacts, each field (name: column) by itself. N counts all chunks; a field's mean length is over all chunks too."""
    listed = exploded(corpus, fields, tokens).withColumn("len", F.size("t").cast("long"))
    stats = listed.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("len").alias("all_len"))
    tf = listed.select("chunk_id", "field", "len", F.explode("t").alias("token")).groupBy("field", "token", "chunk_id", "len").agg(F.count("*").alias("tf"))
    tf = materialize(tf, "term-frequencies")
    return index_of(tf, tf.groupBy("field", "token").agg(F.count("*").alias("df")), stats, k1, b)


def index_of(tf: DataFrame, df: DataFrame, stats: DataFrame, k1: float = 1.2, b: float = 0.75) -> Index:
    """Impacts ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b len / avg)).

    tf: field, token, chunk_id, len, tf. df: field, token, df. stats: field, n_docs, all_len.
    """
    rows = tf.join(df, ["field", "token"]).join(F.broadcast(stats), "field")  # a row of statistics for each field
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / (F.col("all_len") / F.col("n_docs")))
    return _banded(rows.select("field", "token", "chunk_id", (idf * F.col("tf") * (k1 + 1) / norm).alias("impact")))


def asked_terms(queries: DataFrame, weights: dict[str, float], grouped: bool, by_share: bool) -> DataFrame:
    """query_id, grp, field, token, weight, n_tokens of every query (query_id, text).

    ``grouped``: a group for each field, else one for all. ``by_share``: weights are divided by the query's tokens.
    """
    told = queries.select("query_id", token_set(F.col("text")).alias("t")).withColumn("n_tokens", F.size("t"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w)).alias("weight")) for f, w in weights.items()])
    rows = told.select("query_id", "n_tokens", F.explode("t").alias("token"), fields.alias("f")).select("query_id", "n_tokens", "token", F.explode("f").alias("f"))
    weight = F.col("f.weight") / F.col("n_tokens") if by_share else F.col("f.weight")
    return rows.select("query_id", F.when(F.lit(grouped), F.col("f.field")).otherwise("all").alias("grp"), "f.field", "token", weight.alias("weight"), "n_tokens")


def matched(index: Index, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, chunk_id, grp, field, n, total: by field, what the chunks of pairs (query_id, chunk_id) have of their query's terms."""
    own = index.postings.join(pairs, "chunk_id").join(terms, ["query_id", "field", "token"])
    return own.groupBy("query_id", "chunk_id", "grp", "field").agg(F.count("*").alias("n"), F.sum(F.col("weight") * F.col("impact")).alias("total"))


def _scores(index: Index, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    by_group = matched(index, terms, pairs).groupBy("query_id", "chunk_id", "grp").agg(F.sum("total").alias("total"))
    return by_group.groupBy("query_id", "chunk_id").agg(F.max("total").alias("score"))


def candidates(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id: pairs among which the k best of every query are, ties in the rounded score included."""
    bound = F.col("weight") * F.col("top")
    items = terms.join(index.bands, ["field", "token"]).withColumn("most", bound)
    before = Window.partitionBy("query_id", "grp", "field", "token").orderBy("most", "band")
    items = items.withColumn("adds", F.col("most") - F.coalesce(F.lag("most").over(before), F.lit(0.0)))
    items = materialize(items.select("query_id", "grp", "field", "token", "band", "weight", "most", "adds", "n"), "query-bands")

    # seeds: the rarest bands, until they hold a few times k chunks
    rare = Window.partitionBy("query_id").orderBy("n", F.desc("most"), "field", "token", "band")
    seen = F.coalesce(F.sum("n").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    seeds = items.withColumn("seen", seen).where(F.col("seen") < SEEDS * k)
    hits = seeds.join(index.postings, ["field", "token", "band"]).groupBy("query_id", "grp", "chunk_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("part"))
    best = Window.partitionBy("query_id").orderBy(F.desc("part"), "chunk_id")
    tried = hits.groupBy("query_id", "chunk_id").agg(F.max("part").alias("part")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= SEEDS * k).select("query_id", "chunk_id")
    ranked = _scores(index, terms, tried).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    floor = materialize(ranked.where(F.col("r") == k).select("query_id", (F.col("score") - SLACK).alias("floor")), "floors")

    # bands that can't reach the floor together, in ascending order of what they can add
    up = Window.partitionBy("query_id", "grp").orderBy("most", "field", "token", "band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = items.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("reach", F.sum("adds").over(up))
    idle = told.where(F.col("reach") < F.col("floor")).groupBy("query_id", "grp").agg(F.max("reach").alias("rest"))
    live = told.where(F.col("reach") >= F.col("floor")).join(idle, ["query_id", "grp"], "left")
    found = live.join(index.postings, ["field", "token", "band"]).groupBy("query_id", "grp", "chunk_id").agg(
        F.sum(F.col("weight") * F.col("impact")).alias("part"), F.first("floor").alias("floor"), F.first(F.coalesce("rest", F.lit(0.0))).alias("rest")
    )
    return materialize(found.where(F.col("part") + F.col("rest") >= F.col("floor")).select("query_id", "chunk_id").distinct(), "candidates")


def best_fields(index: Index, queries: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """query_id, chunk_id, score: the k best (and whatever ties with them) by the largest of the fields' weighted scores."""
    terms = materialize(asked_terms(queries, weights, grouped=True, by_share=False), "query-terms")
    return _scores(index, terms, candidates(index, terms, k)).withColumn("score", F.round("score", 6))


def weighted_shares(index: Index, queries: DataFrame, weights: dict[str, float], k: int | None, also: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score: the shares of a query's tokens that each field has, weighted, in the order of the weights.

    The k best are among the rows, and the pairs (query_id, chunk_id) of ``also``; with no k only those.
    """
    terms = materialize(asked_terms(queries, weights, grouped=False, by_share=True), "query-terms")
    pairs = candidates(index, terms, k) if k else None
    if also is not None:
        own = also.select("query_id", "chunk_id")
        pairs = own if pairs is None else pairs.union(own).distinct()
    each = matched(index, terms, pairs).groupBy("query_id", "chunk_id").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("n"))), F.lit(0)).alias(f"n_{f}") for f in weights])
    sizes = terms.select("query_id", "n_tokens").distinct()

    def share(f: str) -> Column:
        return F.col(f"n_{f}") / F.col("n_tokens") * weights[f]

    first, *more = weights
    score = share(first)
    for f in more:
        score = score + share(f)
    return each.join(sizes, "query_id").select("query_id", "chunk_id", score.alias("score"))
