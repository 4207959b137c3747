"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources are clamped at ``max_epochs`` times their size and the excess is shared again by weight
among the rest until no source is above its clamp. The fixed point of that loop is one water
level: with sources in ascending order of clamp to weight, all up to some place are clamped and
the rest get ``level * weight``; window sums over the per-source table find it.

Every document is taken ``floor(target / source size)`` whole times. The fraction left is a
seeded sample: documents of the source in the order of a seeded hash, until the words are
reached; the one document at the boundary is taken in part (up to a word's end), so a source's
taken words equal its target to the rounding.

Defined cases: null text has size 0; null source is a source of its own, last in order; a null
doc_id is hashed as "null"; documents of equal hash go by size (equal rows are interchangeable);
a source without words has target 0; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame, seed: str, *keep: str) -> DataFrame:
    """_id, _k (source key in code point order, null last), _size, _u (seeded hash), _b (its bucket), and columns kept."""
    told = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    u = F.md5(F.concat(F.lit(f"{seed}:"), told))
    return docs.select(
        *keep,
        told.alias("_id"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("_k"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        u.alias("_u"),
        F.substring(u, 1, 3).alias("_b"),
    )


def measure(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, k, size, u, b of every document."""
    return measured(docs, seed, "doc_id").select("doc_id", F.col("_k").alias("k"), F.col("_size").alias("size"), F.col("_u").alias("u"), F.col("_b").alias("b"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """k, source_size, target: the per-source table (one row a source, so a window over all is small)."""
    per = sizes.groupBy("k").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    per = per.withColumn("place", F.row_number().over(Window.orderBy("k")) - 1).withColumn(
        "w", F.try_element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % n + 1).cast("int"))
    )
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), "k")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    zero = F.lit(0).cast("long")
    per = (
        per.withColumn("size_before", F.coalesce(F.sum("source_size").over(before), zero))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), zero))
        .withColumn("size_all", F.sum("source_size").over(everything))
        .withColumn("w_all", F.sum("w").over(everything))
        .withColumn("left", share * F.col("size_all") - max_epochs * F.col("size_before"))
        .withColumn("w_left", F.col("w_all") - F.col("w_before"))
        .withColumn("free", F.col("left") * F.col("w") <= max_epochs * F.col("source_size") * F.col("w_left"))
    )
    # the first free place in the order sets the level for itself and all after it
    level = F.min(F.when(F.col("free"), F.struct(F.col("size_before"), F.col("w_before"), F.col("left"), F.col("w_left")))).over(everything)
    return per.withColumn("level", level).select(
        "k",
        "source_size",
        F.when(F.col("w_before") < F.col("level.w_before"), max_epochs * F.col("source_size"))
        .otherwise(F.col("level.left") * F.col("w") / F.col("level.w_left"))
        .alias("target"),
    )


def source_goals(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """k, source_size, target, whole (repetitions of every document) and rest (words taken once more)."""
    goal = targets(sizes, weights, share, max_epochs).select(
        "k",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    )
    return goal.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))


def hash_buckets(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """The goal's columns, b and bucket_before: the words of the source before a bucket of its hash order.

    A source's hash order is cut into 4,096 buckets, so that a hot source is summed in many tasks.
    """
    run = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sizes.groupBy("k", "b").agg(F.sum("size").alias("in_bucket"))
    return buckets.withColumn("bucket_before", F.coalesce(F.sum("in_bucket").over(run), F.lit(0).cast("long"))).drop("in_bucket").join(goal, "k")


def shares(sizes: DataFrame, buckets: DataFrame) -> DataFrame:
    """sizes with the columns of their buckets and part: the words taken once more."""
    inside = Window.partitionBy("k", "b").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("bucket_before") - F.col("inside")))
    return ranked.join(buckets, ["k", "b"]).withColumn("part", part)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
) -> DataFrame:
    """Per document: doc_id, k, u, size, source_size, target, whole (repetitions), part (words), taken."""
    sizes = materialize(measure(docs, seed), "mix-sizes")
    taken = shares(sizes, hash_buckets(sizes, source_goals(sizes, weights, share, max_epochs)))
    return taken.withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).select("doc_id", "k", "u", "size", "source_size", "target", "whole", "part", "taken")


def leading_words(text: Column, k: Column) -> Column:
    """The text up to the end of its k-th word."""
    gaps, words = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lengths = F.zip_with(F.slice(gaps, F.lit(1), k), F.slice(words, F.lit(1), k), lambda g, w: F.length(g) + F.length(w))
    return F.substring(text, F.lit(1), F.aggregate(lengths, F.lit(0), lambda a, x: a + x))


def mixed_documents(
    docs: DataFrame,
    cut: bool = True,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
) -> DataFrame:
    """The mix itself: every column of docs, one row per repetition; a document in part is its text up to a word's end.

    Without ``cut`` a document in part is taken whole or not at all, whichever is nearer the target.

    What a document is taken for follows from its source and its bucket, but in the one bucket of
    each source that holds the boundary. Only the documents of that bucket meet the ranked plan, so
    other texts aren't shuffled unless the table of sources is too large to broadcast. Rows of equal
    doc_id and size share their plan, one of the equal plans each.
    """
    sizes = materialize(measure(docs, seed), "mix-sizes")
    goal = materialize(source_goals(sizes, weights, share, max_epochs), "mix-goals")
    buckets = materialize(hash_buckets(sizes, goal), "mix-buckets")
    edge = buckets.where("bucket_before < rest").groupBy("k").agg(F.max("b").alias("b"))
    key = ["_id", "_k", "_size"]
    part = F.col("part") if cut else F.when(F.col("part") * 2 >= F.col("size"), F.col("size")).otherwise(0).cast("long")
    plan = shares(sizes.join(edge, ["k", "b"], "left_semi"), buckets).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.col("k").alias("_k"), F.col("size").alias("_size"), part.alias("_part")
    )
    plan = plan.groupBy(*key, "_part").agg(F.count("*").alias("_times"))
    upto = Window.partitionBy(*key).orderBy("_part")
    plan = plan.withColumn("_to", F.sum("_times").over(upto)).withColumn("_from", F.col("_to") - F.col("_times"))

    per_source = goal.join(edge, "k", "left").select(F.col("k").alias("_k"), F.col("whole").alias("_whole"), F.coalesce("b", F.lit("")).alias("_edge"))
    rows = measured(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text"), seed, "_row").join(per_source, "_k")
    rest = rows.where("_b <> _edge").withColumn("_part", F.when(F.col("_b") < F.col("_edge"), F.col("_size")).otherwise(0).cast("long"))
    turn = Window.partitionBy(*key).orderBy(F.xxhash64("_row.text"))
    ranked = rows.where("_b = _edge").withColumn("_turn", F.row_number().over(turn) - 1)
    met = ranked.join(plan, key).where("_turn >= _from and _turn < _to").select(*rest.columns)
    joined = rest.unionByName(met)

    none = F.array().cast("array<bigint>")
    all_words = F.lit(-1).cast("long")
    copies = F.concat(
        F.array_repeat(all_words, F.col("_whole").cast("int")),
        F.when((F.col("_part") == F.col("_size")) & (F.col("_size") > 0), F.array(all_words)).when(F.col("_part") > 0, F.array(F.col("_part"))).otherwise(none),
    )
    joined = joined.withColumn("_words", F.explode(copies))
    text = F.when(F.col("_words") < 0, F.col("_row.text")).otherwise(leading_words(F.col("_row.text"), F.col("_words").cast("int")))
    fields = []
    for f in docs.schema.fields:
        if f.name == "text":
            fields.append(text.alias("text"))
        elif f.name == "n_chars":
            fields.append(F.when(F.col("_words") < 0, F.col("_row.n_chars")).otherwise(F.length(text)).cast(f.dataType).alias("n_chars"))
        else:
            fields.append(F.col("_row").getField(f.name).alias(f.name))
    return joined.select(*fields)
