"""Citation policy and metadata filters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import rules


def citation_role(source: Column, table: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The role a source can play in an answer; unknown ones explain."""
    t = table or {
        "primary_legal_basis": rules.PRIMARY_SOURCES,
        "conditional_local_basis": rules.LOCAL_SOURCES,
        "conditional_industry_basis": rules.INDUSTRY_SOURCES,
        "implementation_reference": rules.IMPLEMENTATION_SOURCES,
        "interpretation_auxiliary": rules.AUXILIARY_SOURCES,
    }
    known = [F.when(source.isin(*ids), F.lit(role)) for role, ids in t.items()]
    return F.coalesce(*known[:3], F.when(F.startswith(source, F.lit("tc260_")), F.lit("implementation_reference")), *known[3:], F.lit("interpretation_auxiliary"))


def can_cite_source(role: Column) -> Column:
    return role == "primary_legal_basis"


def can_cite_chunk(role: Column, article_no: Column) -> Column:
    return (role == "primary_legal_basis") & (F.coalesce(article_no, F.lit("")) != "")


def default_retrievable(source: Column) -> Column:
    return F.lit(True)


def direct_reference(source: Column) -> Column:
    return source.isin(*rules.DIRECT_SOURCES)


def usage(role: Column) -> Column:
    return F.coalesce(*[F.when(role == r, F.lit(u)) for r, u in rules.USAGES.items()], F.lit("implementation_reference"))


def filter_chunks(chunks: DataFrame, equal: dict[str, object] | None = None, any_of: dict[str, list[str]] | None = None, is_true: dict[str, bool] | None = None) -> DataFrame:
    """Rows that meet all given conditions: equality, list overlap, and three-valued identity (null is neither)."""
    for column, value in (equal or {}).items():
        chunks = chunks.where(F.col(column) == value)
    for column, values in (any_of or {}).items():
        chunks = chunks.where(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])))
    for column, value in (is_true or {}).items():
        chunks = chunks.where(F.col(column).eqNullSafe(F.lit(value)))
    return chunks


def clause_citable(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.col("law_status") == "effective") & (F.col("citation_role") == "primary_legal_basis") & F.col("can_cite_clause"))


def violations(rows: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """key, rule: one row for each rule that a row breaks (a null check is a break)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def citation_groups(hits: DataFrame) -> DataFrame:
    """case_id, usage, chunk_ids in hit order, scope note; what can't be cited is demoted first.

    hits: case_id, rank, chunk_id, citation_role, can_cite_clause, applicable_region.
    """
    own = hits.withColumn("wanted", usage(F.col("citation_role")))
    demoted = F.when(F.col("wanted").isin("legal_basis", "conditional_basis") & ~F.col("can_cite_clause"), F.lit("implementation_reference")).otherwise(F.col("wanted"))
    own = own.withColumn("usage", demoted)
    note = (
        F.when((F.col("usage") == "conditional_basis") & (F.col("applicable_region") != "CN"), F.concat(F.lit("仅适用于地区："), "applicable_region"))
        .when(F.col("usage") == "implementation_reference", F.lit("参考标准/实施指南，不作为条款级法律依据"))
        .when(F.col("usage") == "policy_explanation", F.lit("政策口径补充，不作为条款级法律依据"))
    )
    return own.withColumn("note", note).groupBy("case_id", "usage").agg(
        F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("c"), F.min_by("note", "rank").alias("scope_note"), F.count_if(F.col("wanted") != F.col("usage")).alias("n_demoted")
    ).select("case_id", "usage", F.array_join(F.transform("c.chunk_id", lambda x: x.cast("string")), ",").alias("chunk_ids"), "scope_note", "n_demoted")
