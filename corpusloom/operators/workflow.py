"""Retrieval for whole review cases: planned queries, two lists, boosts, fusion, issue pools, the second pass.

Every step is the DataFrame of all cases; a group is a case, or a case and an issue, and steps take
the group as their case_id. ``search`` is a function of queries (query_id, text) and k that returns
query_id, chunk_id, score: keyword search, or a vector search of a service.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import rank, review, tables
from corpusloom.storage import materialize

Search = Callable[[DataFrame, int], DataFrame]
Chunks = Callable[[DataFrame], DataFrame]


def hits_of_queries(plan: DataFrame, search: Search, k: int) -> DataFrame:
    """case_id, query_id, query_pos, query_type, chunk_id, score: the k best of every planned query. Equal texts are searched once."""
    texts = plan.select("text").distinct().withColumn("query_id", F.xxhash64("text"))
    found = search(texts, k).select("query_id", "chunk_id", "score").join(texts, "query_id").drop("query_id")
    return plan.select("case_id", "query_id", "query_pos", "query_type", "text").join(found, "text").drop("text")


def merged_list(hits: DataFrame, groups: DataFrame, chunks: DataFrame, facts: DataFrame, list_id: int, k: int, options: dict) -> DataFrame:
    """The hits of a group's queries (case_id, query_id, group) merged by chunk, boosted, as one list."""
    own = hits.join(groups, ["case_id", "query_id"])
    best = rank.merge_queries(own.select(F.struct("case_id", "group").alias("case_id"), "query_pos", "query_type", "chunk_id", "score"), k)
    split = best.select(F.col("case_id.case_id").alias("case_id"), F.col("case_id.group").alias("group"), "chunk_id", "query_type", "score")
    boosted = rank.apply_boosts(split, chunks.drop("query_type", "source_id", "tokens"), facts, **options)
    return boosted.select(F.struct("case_id", "group").alias("case_id"), "chunk_id", "query_type", "score", F.lit(list_id).alias("list_id"))


def candidates(groups: DataFrame, lists: list[DataFrame], chunks: DataFrame, facts: DataFrame, k: int, options: dict) -> DataFrame:
    """case_id (struct of case_id and group), source_id, chunk_id, query_type, score, rank: a group's lists merged, boosted and fused."""
    every = None
    for i, hits in enumerate(lists):
        one = merged_list(hits, groups, chunks, facts, i, k, options)
        every = one if every is None else every.unionByName(one)
    every = every.join(chunks.select("chunk_id", "source_id"), "chunk_id")
    types = every.groupBy("case_id", "chunk_id").agg(F.min_by("query_type", "list_id").alias("query_type"))
    return rank.rrf(every, k).join(types, ["case_id", "chunk_id"])


def _plain(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("case_id.case_id", "case_id.group", "source_id", "chunk_id", "score", "rank", *more)


def issue_pools(issues: DataFrame, lists: list[DataFrame], chunks: DataFrame, facts: DataFrame, k: int, options: dict | None = None) -> DataFrame:
    """case_id, issue_id, source_id, chunk_id, score, rank: each issue's own queries fused and collapsed by source before issues compete for evidence."""
    groups = issues.select("case_id", F.col("issue_id").alias("group"), F.explode("query_ids").alias("query_id"))
    return _plain(rank.source_fuse(candidates(groups, lists, chunks, facts, k, options or {}), chunks, k)).withColumnRenamed("group", "issue_id")


def keyword_retrieval(plan: DataFrame, search: Search, k: int) -> DataFrame:
    """case_id, chunk_id, score, query_type, rank: the hits of all queries of a case, merged by chunk.

    ``search`` may be a service's; what it returns is checked for the columns of hits.
    """
    hits = hits_of_queries(plan, search, k)
    return rank.merge_queries(hits, k).select("case_id", "chunk_id", "score", "query_type", "rank")


class Review(NamedTuple):
    """A case's evidence (with second_pass), verdicts, and what led to them: fused candidates, neighbours of the first places, packets by source."""

    hits: DataFrame
    checks: DataFrame
    candidates: DataFrame
    neighbors: DataFrame
    packets: DataFrame


def hybrid_retrieval(
    plan: DataFrame, facts: DataFrame, chunks: DataFrame | Chunks, searches: list[Search], k: int = 10, pool: int = 50, evidence_terms: tuple[str, ...] | None = None,
    industries: dict[str, tuple[str, ...]] | None = None, expansions: dict[str, tuple[str, ...]] | None = None, options: dict | None = None,
    by_issue: bool = True, issues: DataFrame | None = None, rerank_scores: Callable[[DataFrame], DataFrame] | None = None, window: int = 50, weight: float = 0.4, max_neighbors: int = 10,
) -> Review:
    """Evidence of every case after at most one second pass.

    plan: case_id, query_id, query_pos, query_type, text, and ``initial`` where some queries serve issues only (false).
    facts: as of extract_facts. chunks: what boosts, fusion and the self-check read, or a function that makes it of
    the chunks a table names (chunk_id); what searches find is written, but for ``text``. With ``by_issue`` every issue gets a hit of its own queries; the issues are those given, or made from the plan, and the second
    pass keeps them. ``rerank_scores`` gives case_id, chunk_id, rerank_score of hits (case_id, chunk_id, score,
    rank), blended over the first ``window``. Cases that the self-check sends on are searched again with the
    expanded queries besides their own, for max(k, top_k of the second plan) hits; all others keep the first pass.
    """
    options = options or {}
    of: Chunks = chunks if callable(chunks) else lambda named: tables.among(chunks, named, "chunk_id")
    told = facts.withColumn("cross_border", F.col("cross_border_transfer"))
    queries = plan if "initial" in plan.columns else plan.withColumn("initial", F.lit(True))
    queries = materialize(queries.select("case_id", "query_id", "query_pos", "query_type", "text", "initial"), "plan")
    issues = materialize(issues if issues is not None else review.issue_plan(queries.drop("initial")), "issues") if by_issue else None

    def passed(queries: DataFrame, n: int, second: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        depth = max(n, pool)
        lists = [materialize(hits_of_queries(queries, s, depth), "query-hits") for s in searches]
        met = reduce(DataFrame.unionByName, [hits.select("chunk_id") for hits in lists])
        own_chunks = materialize(of(met).drop("text"), "chunks-met")
        whole = queries.where("initial").select("case_id", F.lit("all").alias("group"), "query_id")
        every = materialize(candidates(whole, lists, own_chunks, told, depth, options), "candidates")
        wide = max(n, window) if rerank_scores else n
        chosen = _plain(rank.source_fuse(every, own_chunks, wide)).drop("group")
        if issues is not None:
            own = issues.join(queries.select("case_id").distinct(), "case_id", "left_semi")
            pools = materialize(issue_pools(own, lists, own_chunks, told, depth, options), "issue-pools")
            chosen = materialize(chosen, "by-source")
            picked = review.select_by_issue(own, pools, chosen, wide).withColumn("rank", F.col("rank") - 1)
            scores = pools.drop("issue_id").unionByName(chosen.select(*[c for c in pools.columns if c != "issue_id"])).groupBy("case_id", "chunk_id").agg(F.max("score").alias("score"))
            chosen = picked.join(scores, ["case_id", "chunk_id"]).join(own_chunks.select("chunk_id", "source_id"), "chunk_id")
        if rerank_scores:
            chosen = materialize(chosen, "before-rerank")
            blended = rank.rerank(chosen.select("case_id", "chunk_id", "score", "rank"), rerank_scores(chosen), n, window, weight)
            chosen = blended.join(own_chunks.select("chunk_id", "source_id"), "chunk_id")
        chosen = materialize(chosen.where(F.col("rank") < n).select("case_id", "source_id", "chunk_id", "score", "rank").withColumn("second_pass", F.lit(second)), "evidence")
        top = chosen.where("rank < 5").select("case_id", "chunk_id", "rank")
        near = rank.expand_neighbors(top, of(top), max_neighbors)
        near = near.join(of(near).select("chunk_id", "source_id"), "chunk_id")
        return chosen, _plain(every, "query_type").drop("group"), materialize(near, "neighbors")

    def check(hits: DataFrame) -> DataFrame:
        seen = hits.select("case_id", "chunk_id").join(of(hits).select("chunk_id", "citation_role", "can_cite_clause", "applicable_region", "subject_words", "title", "text"), "chunk_id")
        more = {"evidence_terms": evidence_terms} if evidence_terms else {}
        return materialize(review.self_check(facts, seen, industries=industries, **more), "checks")

    first = passed(queries, k, False)
    checks = check(first[0])
    more = materialize(review.second_plan(facts, checks, expansions), "second-plan")
    deep = max(k, more.agg(F.max("top_k")).first()[0] or 0)
    own = queries.join(checks.where("status = 'needs_second_retrieval'").select("case_id"), "case_id", "left_semi")
    expanded = more.select("case_id", F.concat(F.lit("s"), "query_id").alias("query_id"), (F.substring("query_id", 3, 9).cast("int") + 10_000).alias("query_pos"), "query_type", "text", F.lit(True).alias("initial"))
    again = passed(own.unionByName(expanded), deep, True)
    searched = own.select("case_id").distinct()
    hits, every, near = (a.join(searched, "case_id", "left_anti").unionByName(b) for a, b in zip(first, again, strict=True))
    second_checks = check(again[0]).join(searched, "case_id", "left_semi")
    final = review.after_second(second_checks).unionByName(checks.join(searched, "case_id", "left_anti"))
    return Review(hits, final, every, near, rank.source_packets(hits, every, neighbors=near))
