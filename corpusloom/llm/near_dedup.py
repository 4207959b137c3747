"""MinHash near-dedup: an LSH forest of sorted signature orders, exact confirmation, components.

Words are the runs of other than ASCII white space, A-Z in lower case; a document's set is its
distinct shingles of ``n`` words (with fewer words, the whole sequence as one). Documents whose
sets have a Jaccard similarity of at least ``threshold`` percent are linked; the class of a
document is the component of links, named by its smallest doc_id.

1. Equal sets are one class, stood for by the smallest id, so that exact copies never meet.
2. ``TREES`` orders of one signature of ``HASHES`` values: each tree's label is the ``DEEP`` values
   from its own place on. Only documents whose labels share ``DEPTH`` values (a region) can be
   candidates. A region of more than ``DENSE`` documents is gone into value by value, each document
   to the least depth at which its part is small enough. Every part is sorted by label, and the
   neighbours in that order, which have the longest common prefix on either side, are candidates;
   so is the first document of the region, so that candidates grow linearly with a region.
3. Candidates are confirmed on full sets: first the one with the longest common prefixes over
   all trees, then the others where the two are not yet in one component.
4. In every region, of whatever size, that holds more than one component then, the signatures of
   the documents outside its largest component are compared with all its signatures, block by
   block of bounded size, inside tasks, whether or not they resemble the region's first document.
   Components whose members agree in ``ALIKE`` of the values are neighbours.
5. What is left apart is settled exactly: in every neighbourhood (candidates with at least
   ``REGION`` similarity and neighbours of step 4, connected) the documents outside its largest
   component are compared with all its documents, in such blocks as well.

A pair at the threshold of 0.8 shares no region with probability (1 - 0.8^5)^24 = 7e-5, were the
trees independent (half of a label's values are the next tree's as well), and a pair that shares one
agrees in less than ``ALIKE`` of its values with less than 1e-6. Nothing is capped. Steps 4 and 5 are
the exact way for what the orders leave apart: regions of many documents that neither link nor
resemble each other are quadratic work there. Defined cases: a text that is null or without words has
an empty set and is linked with nothing; rows of one doc_id count as one document; a null doc_id is
linked with nothing, has a null component and is kept; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.prefilter import may_match
from corpusloom.llm.tasks import by_bytes, tidy
from corpusloom.llm.words import shingles, word_groups
from corpusloom.storage import materialize

TREES, DEPTH, DEEP, DENSE = 24, 5, 10, 2048
HASHES = TREES * DEPTH
REGION = 0.5
#: Share of a signature in which two documents of a region agree to be neighbours.
ALIKE = 0.6
#: Shingles in a block of the exact comparison, signatures in a block of a region.
LEFT_BLOCK, MEMBER_BLOCK = 100_000, 400_000
SIGNATURE_BLOCK = 2048
#: Shingles that leave a task in one batch.
OUTPUT_SHINGLES = 500_000

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of every text."""
    for _, words, bounds in word_groups(texts):
        x, at = shingles(words, bounds, n)
        for i in range(len(bounds) - 1):
            k = int(bounds[i + 1] - bounds[i])
            own = x[at[i] : at[i + 1]] if k >= n or not k else shingles(words[bounds[i] : bounds[i + 1]], np.array([0, k]), k)[0]
            yield np.unique(own)


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def signature(values: np.ndarray) -> np.ndarray:
    """HASHES minima of multiply-add hashes of 32 bits."""
    a, b = _parameters()
    low = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    top = (values >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(top), 512):
        low = np.minimum(low, (top[at : at + 512, None] * a[None, :] + b[None, :]).min(axis=0))
    return low


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null: empty), signature (HASHES values of 4 bytes), for every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        np.seterr(over="ignore")
        for batch in batches:
            out: dict[str, list] = {"n_shingles": [], "set_key": [], "signature": []}
            for values in shingle_sets(batch["text"].tolist(), n):
                out["n_shingles"].append(len(values))
                out["set_key"].append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                out["signature"].append(signature(values).tobytes() if len(values) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")} | out)

    schema = "doc_id long, n_shingles long, set_key binary, signature binary"
    return by_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInPandas(tidy(run), schema)


#: The tree is in the low bits of a region's key.
_TREE_BITS = (TREES - 1).bit_length()


def _label(tree: Column | str, depth: int) -> Column:
    """The first ``depth`` values of a tree's label; the values go round."""
    return F.substring(F.concat("signature", F.expr(f"substring(signature, 1, {4 * DEEP})")), tree * (4 * DEPTH) + 1, F.lit(4 * depth))


def forest_members(classes: DataFrame) -> DataFrame:
    """id, region, n, first: the documents of every region of two or more, with its size and smallest id."""
    each = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    low = (1 << _TREE_BITS) - 1
    rows = each.select("id", (F.xxhash64(_label(F.col("tree"), DEPTH)).bitwiseAND(~low)).bitwiseOR(F.col("tree").cast("long")).alias("region"))
    sizes = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    return rows.join(sizes, "region")


def forest_parts(members: DataFrame, classes: DataFrame) -> DataFrame:
    """id, first, label, part: members with the part of their region, of at most about DENSE documents, in which they are sorted."""
    tree = F.col("region").bitwiseAND((1 << _TREE_BITS) - 1).cast("int")
    labelled = members.join(classes.select("id", "signature"), "id").select("id", "region", "n", "first", _label(tree, DEEP).alias("label"))
    few = labelled.where(F.col("n") <= DENSE).select("id", "first", "label", F.col("region").alias("part"), F.lit(0).cast("long").alias("salt"))
    deeper = labelled.where(F.col("n") > DENSE).withColumn("depth", F.explode(F.sequence(F.lit(DEPTH + 1), F.lit(DEEP))))
    deeper = deeper.withColumn("part", F.xxhash64("region", "depth", F.substring("label", F.lit(1), F.col("depth") * 4)))
    sizes = deeper.groupBy("part").agg(F.count("*").alias("in_part"))
    fits = deeper.join(sizes, "part").where((F.col("in_part") <= DENSE) | (F.col("depth") == DEEP))
    # documents that agree in a whole label are dealt out by their ids
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("in_part") / DENSE))
    many = fits.groupBy("id", "region").agg(F.min_by(F.struct("first", "label", "part", salt.alias("salt")), "depth").alias("x")).select("id", "x.*")
    return few.unionByName(many.select(*few.columns))


def forest_candidates(members: DataFrame, classes: DataFrame) -> DataFrame:
    """id, center (of lower id), lcp: linear candidates from all trees; lcp sums the common prefixes."""
    order = Window.partitionBy("part", "salt").orderBy("label", "id")
    sorted_ = forest_parts(members, classes).select("id", "first", "label", F.lag("id").over(order).alias("other"), F.lag("label").over(order).alias("other_label"))
    prefix = lambda c, k: F.expr(f"substring({c}, 1, {4 * k})")
    lcp = sum(((prefix("label", k) == prefix("other_label", k)).cast("int") for k in range(1, DEEP + 1)), F.lit(0))
    near = sorted_.where("other is not null").select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("center"), lcp.alias("lcp"))
    first = members.select("id", F.col("first").alias("center"), F.lit(DEPTH).alias("lcp"))
    return near.unionByName(first).where("id <> center").groupBy("id", "center").agg(F.sum("lcp").alias("lcp"))


def full_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id, set (array of 64-bit hashes): the sets of the documents named in ids. No text is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        for batch in batches:
            ids, sets, size = [], [], 0
            for doc_id, values in zip(batch["id"].tolist(), shingle_sets(batch["text"].tolist(), n), strict=True):
                ids.append(doc_id)
                sets.append(values.view(np.int64))
                size += len(values)
                if size > OUTPUT_SHINGLES:  # a batch of sets is many times as large as its texts
                    yield pd.DataFrame({"id": ids, "set": sets})
                    ids, sets, size = [], [], 0
            if ids:
                yield pd.DataFrame({"id": ids, "set": sets})

    named = may_match(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", ids, "id")
    return by_bytes(named).mapInPandas(tidy(run), "id long, set array<long>").join(ids, "id", "left_semi")


def confirm(pairs: DataFrame, sets: DataFrame, floor: float) -> DataFrame:
    """a, b, shared, joint: sizes of intersection and union, of pairs (a, b) with at least ``floor`` similarity."""
    own = lambda end: sets.select(F.col("id").alias(end), F.col("set").alias(f"set_{end}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    sized = both.select("a", "b", F.col("shared").cast("long").alias("shared"), (F.size("set_a") + F.size("set_b") - F.col("shared")).cast("long").alias("joint"))
    return sized.where(F.col("shared") >= floor * F.col("joint"))


def _linked(threshold: int):
    return F.col("shared") * 100 >= F.col("joint") * threshold


def low_bytes(signatures: pd.Series, pad: int) -> np.ndarray:
    """The low byte of every value, in rows of a multiple of 64: whoever agrees in the values agrees in these."""
    values = np.frombuffer(b"".join(signatures), dtype=np.uint32).reshape(len(signatures), HASHES)
    out = np.full((len(values), -(-HASHES // 64) * 64), pad, dtype=np.uint8)
    out[:, :HASHES] = values & np.uint32(255)
    return out


def neighbours(members: DataFrame, links: DataFrame, signatures: DataFrame) -> DataFrame:
    """a, b: documents of one region that agree in ALIKE of their signatures, at most one for each component and block."""
    own = connected_components(links).select(F.col("node").alias("id"), "component")
    placed = members.select("id", "region").join(own, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = materialize(placed, "region-members")
    parts = placed.groupBy("region", "component").agg(F.count("*").alias("n"))
    regions = parts.groupBy("region").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"))
    regions = regions.where("parts > 1").select(
        "region",
        F.col("main.component").alias("main"),
        F.ceil((F.col("all") - F.col("main.n")) / SIGNATURE_BLOCK).cast("int").alias("left_blocks"),
        F.ceil(F.col("all") / SIGNATURE_BLOCK).cast("int").alias("member_blocks"),
    )
    opened = materialize(placed.join(regions, "region").withColumn("h", F.xxhash64("id")), "region-open")
    named = may_match(signatures, "id", opened, "id")
    bodies = opened.join(named, "id")
    left = bodies.where("component <> main").select(
        "region", F.pmod("h", "left_blocks").alias("x"), F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("y"), "id", "component", "signature"
    )
    right = bodies.select("region", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("x"), F.pmod("h", "member_blocks").alias("y"), "id", "component", "signature")
    right = right.toDF("r_region", "r_x", "r_y", "r_id", "r_component", "r_signature")

    def compare(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        found: list[tuple[int, int]] = []
        if len(l) and len(r):
            told = low_bytes(r["r_signature"], 0)
            asked = low_bytes(l["signature"], 1)
            ids, comps = r["r_id"].to_numpy(), r["r_component"].to_numpy()
            _, code = np.unique(np.concatenate([l["component"].to_numpy(), comps]), return_inverse=True)
            group = np.arange(code.max() + 1)  # components that neighbours have joined in this block
            whole = r["r_signature"].tolist()
            for i, (me, mine) in enumerate(zip(l["id"], l["signature"], strict=True)):
                agree = np.bitwise_count(np.packbits(told == asked[i], axis=1).view(np.uint64)).sum(axis=1)
                own = np.frombuffer(mine, dtype=np.uint32)
                for j in np.flatnonzero(agree >= ALIKE * HASHES):
                    p, q = group[code[i]], group[code[len(l) + j]]
                    if p != q and np.count_nonzero(own == np.frombuffer(whole[j], dtype=np.uint32)) >= ALIKE * HASHES:
                        found.append((int(me), int(ids[j])))
                        group[group == q] = p
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    met = left.groupBy("region", "x", "y").cogroup(right.groupBy("r_region", "r_x", "r_y"))
    return met.applyInPandas(compare, "a long, b long").distinct()


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component."""
    own = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    both = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def settle(near: DataFrame, links: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """a, b: the links inside neighbourhoods that candidates have missed, one for each document and component."""
    inside = connected_components(near.select("a", "b").unionByName(links.select("a", "b")))
    own = connected_components(links)
    nodes = inside.select(F.col("node").alias("id"), F.col("component").alias("region")).join(own.select(F.col("node").alias("id"), "component"), "id", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "id"))
    sized = nodes.join(sets.select("id", F.size("set").cast("long").alias("size")), "id")
    sized = materialize(sized, "settle-nodes")
    parts = sized.groupBy("region", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    regions = parts.groupBy("region").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component", "size")).alias("main"), F.sum("size").alias("all_size"))
    regions = regions.where("parts > 1").select(
        "region",
        F.col("main.component").alias("main"),
        F.ceil((F.col("all_size") - F.col("main.size")) / LEFT_BLOCK).cast("int").alias("left_blocks"),
        F.ceil(F.col("all_size") / MEMBER_BLOCK).cast("int").alias("member_blocks"),
    )
    open_nodes = sized.join(regions, "region").withColumn("h", F.xxhash64("id"))
    open_nodes = materialize(open_nodes, "settle-open")
    bodies = open_nodes.join(sets, "id")
    left = bodies.where("component <> main").select(
        "region", F.pmod("h", "left_blocks").alias("x"), F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("y"), "id", "component", "set"
    )
    right = bodies.select("region", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("x"), F.pmod("h", "member_blocks").alias("y"), "id", "component", "set")
    right = right.toDF("r_region", "r_x", "r_y", "r_id", "r_component", "r_set")

    def compare(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        found: list[tuple[int, int]] = []
        if len(l) and len(r):
            bodies = [np.asarray(s) for s in r["r_set"]]
            sizes = np.array([len(s) for s in bodies])
            owner = np.repeat(np.arange(len(bodies)), sizes)
            tokens = np.concatenate(bodies)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            ids, comps = r["r_id"].to_numpy(), r["r_component"].to_numpy()
            for me, comp, body in zip(l["id"], l["component"], l["set"], strict=True):
                own = np.asarray(body)
                lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(bodies))
                ok = np.flatnonzero((shared * 100 >= (sizes + len(own) - shared) * threshold) & (comps != comp))
                _, firsts = np.unique(comps[ok], return_index=True)
                found += [(int(me), int(ids[i])) for i in ok[firsts]]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return left.groupBy("region", "x", "y").cogroup(right.groupBy("r_region", "r_x", "r_y")).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    rows = materialize(sets_of(docs, n), "near-sets")
    named = rows.where("set_key is not null and doc_id is not null")
    classes = materialize(named.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")), "near-classes")
    # an id with rows of several sets ties their classes
    several = named.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id")
    tied = named.join(several, "doc_id", "left_semi").join(classes.select("set_key", "id"), "set_key").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    members = materialize(forest_members(classes.select("id", "signature")), "forest-members")
    candidates = materialize(forest_candidates(members, classes), "near-candidates")
    ids = candidates.select("id").union(candidates.select("center")).distinct()
    sets = materialize(full_sets(docs, ids, n), "near-full-sets")
    best = candidates.groupBy("id").agg(F.max(F.struct("lcp", (-F.col("center")).alias("m"))).alias("best"))
    first = best.select(F.col("id").alias("a"), (-F.col("best.m")).alias("b"))
    near1 = materialize(confirm(first, sets, REGION), "near-first")
    links1 = near1.where(_linked(threshold)).select("a", "b")
    others = candidates.select(F.col("id").alias("a"), F.col("center").alias("b")).join(first, ["a", "b"], "left_anti")
    near2 = materialize(confirm(_apart(others, connected_components(links1)), sets, REGION), "near-others")
    near = near1.unionByName(near2)
    links = near.where(_linked(threshold)).select("a", "b")
    alike = materialize(neighbours(members, links, classes.select("id", "signature")), "near-alike")
    missed = materialize(settle(near.select("a", "b").unionByName(alike), links, sets, threshold), "near-missed")
    found = connected_components(links.unionByName(missed).unionByName(tied))
    placed = rows.join(classes.select("set_key", "id"), "set_key", "left").join(found, F.col("id") == found["node"], "left")
    component = F.when(F.col("set_key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """docs with one document of each class (the smallest id).

    Of rows with one doc_id, one stays (that of the least text hash); rows without a doc_id all stay.
    """
    found = near_duplicates(docs, n, threshold)
    told = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    told = materialize(told.where("not kept or n > 1").withColumnRenamed("doc_id", "_told"), "near-told")
    same_id = F.col("doc_id").cast("long") == F.col("_told")
    single = docs.join(told.select("_told"), same_id, "left_anti")
    repeated = docs.join(told.where("kept").select("_told"), same_id, "left_semi").groupBy(F.col("doc_id").alias("_same")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("_row"))
    return single.unionByName(repeated.select("_row.*"))
