"""Texts that hold a whole query, by an automaton over all queries.

An Aho-Corasick automaton over the normalised queries passes each normalised text once, whatever the number of
queries. Queries of together at most ``AUTOMATON`` characters go to every task; of more, each query is
known by its rarest run of four bytes, texts meet queries that share it, and a plain search tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import composed_tokens, normalize_text
from corpusloom.operators.scan import normalized
from corpusloom.storage import materialize

#: Characters of queries that an automaton in every task may hold (some 100 bytes each).
AUTOMATON = 2_000_000


def phrase_pairs(corpus: DataFrame, queries: DataFrame, column: str, most: int = AUTOMATON) -> DataFrame:
    """query_id, chunk_id of the texts that hold the whole normalised query of PHRASE_LEAST characters or more."""
    asked = queries.select("query_id", normalize_text(F.col("text")).alias("q")).where(F.length("q") >= rules.PHRASE_LEAST)
    asked = materialize(asked.dropDuplicates(), "phrases")
    composed = composed_tokens(F.coalesce(F.col(column), F.lit("")))
    distinct = asked.select("q").distinct()
    size = distinct.agg(F.sum(F.length("q"))).first()[0] or 0
    if size <= most:
        found = by_automaton(corpus.select("chunk_id", composed.cast("binary").alias("body")), [r.q for r in distinct.collect()])
    else:
        found = by_rare_runs(corpus.select("chunk_id", normalize_text(F.coalesce(F.col(column), F.lit(""))).alias("body")), distinct)
    return found.join(asked, "q").select("query_id", "chunk_id")


def by_automaton(texts: DataFrame, phrases: list[str]) -> DataFrame:
    """chunk_id, q of the texts (chunk_id, body: composed, as UTF-8) that hold a phrase when normalised."""
    kind = texts.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            automaton.add_word(p, i)
        automaton.make_automaton()
        for batch in batches:
            rows, told = [], []
            for i, body in enumerate(batch.column(1)):
                for p in {p for _, p in automaton.iter(normalized(body.as_py()))}:
                    rows.append(i)
                    told.append(phrases[p])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(told, pa.string())], ["chunk_id", "q"])

    if not phrases:
        return texts.select("chunk_id", F.col("body").cast("string").alias("q")).where(F.lit(False))
    return texts.mapInArrow(run, f"chunk_id {kind}, q string")


def _runs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, run: every distinct run of four bytes of a text."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column(1)):
                data = np.frombuffer(body.as_py(), dtype=np.uint8).astype(np.uint32)
                if len(data) >= 4:
                    found = np.unique(data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(found), i))), pa.array(found)], [key, "run"])

    return rows.select(key, F.col(text).cast("binary").alias("_raw")).mapInArrow(run, f"{key} {kind}, run long")


def by_rare_runs(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """chunk_id, q as of an automaton, for any number of phrases (q)."""
    of_phrases = materialize(_runs(phrases, "q", "q"), "phrase-runs")
    # only runs of phrases are counted and kept of the texts
    kept = materialize(_runs(texts, "chunk_id", "body").join(of_phrases.select("run").distinct(), "run", "left_semi"), "text-runs")
    counts = kept.groupBy("run").agg(F.count("*").alias("n"))
    # a phrase with a run that no text has is in none
    rarest = of_phrases.join(counts, "run", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "run")).alias("x")).where("x.n > 0").select("q", "x.run")
    near = materialize(kept.join(rarest, "run").select("chunk_id", "q"), "phrase-candidates")
    return near.join(texts, "chunk_id").where(F.contains("body", "q")).select("chunk_id", "q")
