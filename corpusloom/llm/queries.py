"""The registered query of each training-data operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, fill_middle, fingerprints, mixing, near_dedup, packing, quality, secrets, substring_dedup, topk, toxicity, vector_codes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _turns(rows: Column) -> Column:
    """role, \\n, text, \\n of every turn."""
    return F.array_join(F.transform(rows, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        marks.alias("text"),
    )
    chats = chat_format.format_conversations(turns.unionByName(extra))
    loss = chat_format.loss_text(F.col("segments"))
    back = chat_format.read_back(F.col("formatted"))
    return chats.select(
        "conv_id",
        F.size(back).cast("long").alias("n_turns"),
        _sha(_turns(back)).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        _sha(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_error",
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end,
         length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g')) + length(role) - length(replace(role, chr(10), '')) AS role_chars,
         length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g')) AS text_chars
  FROM t
), f AS (
  SELECT *, CASE WHEN before IS NULL AND role IN ('system', 'user') THEN 0 WHEN before = 'system' AND role = 'user' THEN 0
                 WHEN before = 'user' AND role = 'assistant' THEN 0 WHEN before = 'assistant' AND role = 'user' THEN 0 ELSE 1 END AS bad
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(9 + role_chars + text_chars) AS BIGINT) AS formatted_chars,
       sum(bad) = 0 AND bool_or(from_end = 1 AND role = 'assistant') AS valid,
       min(CASE WHEN bad = 1 THEN i END) AS first_error
FROM f GROUP BY conv_id
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_paths())


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u
  FROM documents
), p AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY k
), o AS (
  SELECT *, CAST(coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS size_before, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS w_before,
         CAST(sum(source_size) OVER () AS BIGINT) AS size_all, CAST(sum(w) OVER () AS BIGINT) AS w_all
  FROM p WINDOW b AS (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, CAST(1.5 AS DOUBLE) * size_all - CAST(2 AS DOUBLE) * size_before AS rest, w_all - w_before AS w_rest FROM o
), first_free AS (
  SELECT w_before AS level_at, rest AS level_rest, w_rest AS level_w FROM l
  WHERE rest * w <= CAST(2 AS DOUBLE) * source_size * w_rest ORDER BY size_before, w_before LIMIT 1
), t AS (
  SELECT k, source_size, CASE WHEN w_before < level_at THEN CAST(2 AS DOUBLE) * source_size ELSE level_rest * w / level_w END AS target
  FROM l CROSS JOIN first_free
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), q AS (
  SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS rest FROM g
), c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.rest,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.k ORDER BY d.u, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN q USING (k)
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c
"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        _sha(secrets.listed(base)).alias("base_sha256"),
        secrets.listed(F.concat(base, F.col("random"))).alias("spans"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=2, threshold=80)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def _scored(scores: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scores.select(
        "doc_id",
        toxicity.held_out(modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(~toxicity.held_out(3, 1)))
    return _scored(quality.score(docs, model), 3, 1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out(5, 0)))
    return _scored(toxicity.score(docs, model), 5, 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """Three assignments and, between them, two moves of the entries."""
    assign = """
a{i} AS (
  SELECT rid, part, min(CAST(list_inner_product(p.c, p.c) - 2 * list_inner_product(p.c, b.c) + list_inner_product(b.c, b.c) AS BIGINT) * 64 + entry) AS m
  FROM p JOIN b{i} AS b USING (part) GROUP BY rid, part
)"""
    move = """, m{j} AS (
  SELECT part, m % 64 AS entry, i, floor(sum(c[i]) / count(*)) AS x
  FROM a{i} JOIN p USING (rid, part), width, (SELECT unnest(range(1, 100)) AS i) WHERE i <= w GROUP BY part, m % 64, i
), b{j} AS (
  SELECT part, entry, coalesce(n.c, o.c) AS c
  FROM b{i} AS o LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS c FROM m{j} GROUP BY part, entry) AS n USING (part, entry)
),"""
    steps = "".join(assign.format(i=i) + (move.format(i=i, j=i + 1) if i < 2 else "") for i in range(3))
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), width AS (SELECT CAST(ceil(max(len(q)) / 16) AS BIGINT) AS w FROM k
), p AS (
  SELECT rid, part, list_resize(q, 16 * w, 0.0)[part * w + 1:part * w + w] AS c FROM k, width, (SELECT unnest(range(16)) AS part)
), b0 AS (SELECT part, rid - 1 AS entry, c FROM p WHERE rid <= 64),{steps}, e AS (
  SELECT rid, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY rid
), h AS (
  SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM b2, width, (SELECT unnest(range(1, 100)) AS i) WHERE i <= w
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (rid) CROSS JOIN h
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = warc.archive_pages(table(spark, sf_dir, "pages"), least=1000)
    broken = normal.where("error is not null").first()
    if broken is not None:
        raise ValueError(f"{broken.archive}: {broken.error}")
    found = warc.read_records(warc.read_index(normal), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_middle(table(spark, sf_dir, "documents"), seed=42, rate=50, spm=80)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        _sha(F.col("output")).alias("output_sha256"),
        _sha(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), e AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), f AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS s
  FROM e
)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_quality": op3_quality,
        "op4_packing": op4_packing,
        "op5_topk": op5_topk,
        "op6_fingerprints": op6_fingerprints,
        "op7_mixing": op7_mixing,
        "op8_secrets": op8_secrets,
        "op9_near_dedup": op9_near_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_vector_codes": op11_vector_codes,
        "op12_warc": op12_warc,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op5_topk": OP5_SQL, "op7_mixing": OP7_SQL, "op11_vector_codes": _codes_sql(), "op12_warc": OP12_SQL, "op13_fill_middle": OP13_SQL}
