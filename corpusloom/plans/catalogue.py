"""Registered queries of the engine and their DuckDB twins. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.json_text import json_to_text
from corpusloom.functions.text import html_to_text, jaccard, mock_embedding, normalize_text, token_set, tokens
from corpusloom.operators import chunk, clean, evaluate, policy, rank, report, result, retrieve, review, scan, tables, vector_index, workflow
from corpusloom.operators.phrases import phrase_pairs
from corpusloom.plans.sql import ORACLES
from corpusloom.sources import parse
from corpusloom.sources.bindings import corpus, queries as asked, semantic_corpus, table
from corpusloom.storage import materialize
from corpusloom.streaming import ingest

FIELDS = {"body": "text", "title": "title"}
#: An ASCII dictionary for the fact rules, in the manner of the tables' invented prose.
ASCII = review.Dictionary(
    cross_border=("export", "abroad"), verbs=("send", "transfer"), recipients={"tion": "tion", "eaux": "eaux", "ung": "ung"},
    data_types={"the": "article", "der": "article", "que": "pronoun", "en": "preposition"}, sensitive=("erheou", "schst"),
    industries={"ingth": "ingth", "heit": "heit", "mente": "mente"}, regions={"ouer": "ouer", "keit": "keit"},
    consent={"and": "agreed", "und": "agreed"}, negations=("not", "no"), unflipped=("und",), purposes=("for", "pour", "para"), volume=("th", "ch"),
)
TEMPLATES = [(("tion", "heit"), "assessment conditions", False, ()), (("er",), "standard contract", True, ("th",))]
WORDS = {"cross_border": "export", "sensitive": "sensitive", "region": "list", "focus_abroad": "export", "focus_home": "security", "industry": "rules"}


def normalize_text_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", normalize_text(F.col("text")).alias("n"), tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("n").cast("long").alias("n_chars"), F.size("t").cast("long").alias("n_tokens"), F.md5("n").alias("digest"))


def token_sets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(token_set(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _keyword(spark: SparkSession, d: str, k: int, fields: dict[str, str] | None = None, phrase: str | None = "text") -> DataFrame:
    return retrieve.keyword_search(corpus(spark, d), asked(spark, d), k, fields or FIELDS, phrase).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d, 10)


def keyword_phrase_boost(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.phrase_hits(corpus(spark, d), asked(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def field_weighted_search(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d, 10, FIELDS | {"label": "label", "heading": "lang"}, None)


def semantic_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.semantic_search(semantic_corpus(spark, d), asked(spark, d), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25(corpus(spark, d), asked(spark, d), 10).select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_fields_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).withColumn("tag", F.concat_ws(" ", "topic_tags"))
    found = retrieve.bm25(rows, asked(spark, d), 10, {"title": "title", "label": "label", "heading": "lang", "text": "text", "tag": "tag"}, {"title": 2.0, "label": 2.0})
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = table(spark, d, "embeddings")
    return retrieve.cosine_search(v, v.where(F.col("vec_id") % 20 == 0), k)


def vector_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d, 10).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def vector_label_recall(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _neighbours(spark, d, 10).join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return hits.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("own")).alias("n_same"), F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))).cast("long").alias("first_same"))


def vector_ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """What an inverted file finds of the ten nearest of every query, against the exact search."""
    v = table(spark, d, "embeddings")
    found = vector_index.search(vector_index.build(v), v.where(F.col("vec_id") % 20 == 0), 10)
    return vector_index.recall_at_k(found, _neighbours(spark, d, 10))


def _lists(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The body list (0) and the title list (1) of every benchmark item, as hits of a case; a table, as queries read it often."""
    rows, q = corpus(spark, d), asked(spark, d)
    index = scan.Texts(rows, {"body": "text", "title": "title"})
    body = retrieve.top_k(index.weighted_shares(q, {"body": 1.0}, k), k).withColumn("list_id", F.lit(0))
    title = retrieve.top_k(index.weighted_shares(q, {"title": 1.0}, k), k).withColumn("list_id", F.lit(1))
    both = body.unionByName(title).withColumnRenamed("query_id", "case_id")
    return materialize(both.join(rows.select("chunk_id", "source_id"), "chunk_id"), "lists")


def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    hits = _lists(spark, d).withColumn("query_pos", F.col("list_id"))
    return rank.merge_queries(hits, 20).select("case_id", "chunk_id", "score", F.col("list_id").cast("long").alias("query_pos"), F.col("rank").cast("long").alias("rank"))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return rank.rrf(_lists(spark, d), 20).select("case_id", "chunk_id", "score", "n_lists", F.col("rank").cast("long").alias("rank"))


def rrf_fuse_many(spark: SparkSession, d: str) -> DataFrame:
    third = _keyword(spark, d, 50, FIELDS | {"label": "label"}).withColumn("list_id", F.lit(2)).withColumnRenamed("query_id", "case_id").join(corpus(spark, d).select("chunk_id", "source_id"), "chunk_id")
    hits = _lists(spark, d).select("case_id", "chunk_id", "score", "source_id", "list_id").unionByName(third.select("case_id", "chunk_id", "score", "source_id", "list_id"))
    return rank.rrf(hits, 20).select("case_id", "chunk_id", "score", "n_lists", F.col("rank").cast("long").alias("rank"))


def _facts_by_case(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a case from its number: a transfer for even ones, a region by three, an industry by two."""
    q = asked(spark, d)
    return q.select(
        F.col("query_id").alias("case_id"), (F.col("query_id") % 2 == 0).alias("cross_border"),
        F.when(F.col("query_id") % 3 == 0, "广东").when(F.col("query_id") % 3 == 1, "上海").alias("region"), F.when(F.col("query_id") % 2 == 1, "en").alias("industry"),
    )


def metadata_boosts(spark: SparkSession, d: str) -> DataFrame:
    hits = _lists(spark, d).where("list_id = 0")
    rows = tables.among(corpus(spark, d), hits, "chunk_id").select(
        "chunk_id", "citation_role", (F.col("citation_role") == "primary_legal_basis").alias("primary_like"), F.concat_ws(" ", "title", F.substring("text", 1, 500)).alias("mentions"),
        "applicable_region", F.concat_ws(" ", "topic_tags").alias("subject_words"), F.when(F.col("chunk_id") % 5 == 0, "missing_information").otherwise("legal_issue").alias("query_type"),
    )
    own = rank.apply_boosts(hits, rows, _facts_by_case(spark, d), cross_border_terms=("the", "der"), industries={"en": ("en",)})
    return own.select("case_id", "chunk_id", F.round("boost", 6).alias("boost"), "score")


def _boosted(spark: SparkSession, d: str, lists: DataFrame | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    lists = _lists(spark, d) if lists is None else lists
    rows = tables.among(corpus(spark, d), lists, "chunk_id").select("chunk_id", F.col("doc_id").alias("chunk_index"), "article_no", none.alias("prev_chunk_id"), none.alias("next_chunk_id"), token_set(F.col("text")).alias("tokens"))
    fused = rank.rrf(lists, 50).withColumn("query_type", F.when(F.col("chunk_id") % 4 == 0, "missing_information").otherwise("material_fact"))
    return rank.source_fuse(fused, rows, 10)


def source_aware_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d).select("case_id", "source_id", "chunk_id", "score", F.col("n_supports").cast("long").alias("n_supports"), F.col("rank").cast("long").alias("rank"))


def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d)
    hits = rank.rrf(lists, 50)
    rows = tables.among(corpus(spark, d), lists, "chunk_id").select("chunk_id", token_set(F.col("title")).alias("t"))
    q = asked(spark, d).select(F.col("query_id").alias("case_id"), token_set(F.col("text")).alias("q"))
    scores = hits.join(rows, "chunk_id").join(q, "case_id").select("case_id", "chunk_id", F.round(jaccard(F.col("q"), F.col("t")), 6).alias("rerank_score"))
    return rank.rerank(hits.select("case_id", "chunk_id", "score", "rank"), scores, 20).select("case_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return chunk.fixed_windows(table(spark, d, "documents"), 400, 80)


def fixed_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    return w.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("digest"))


def chunk_links(spark: SparkSession, d: str) -> DataFrame:
    return chunk.linked(_windows(spark, d)).select("chunk_id", "prev_chunk_id", "next_chunk_id")


def neighbor_expansion(spark: SparkSession, d: str) -> DataFrame:
    best = materialize(_boosted(spark, d).select("case_id", "chunk_id", "rank"), "best-sources")
    docs = tables.among(table(spark, d, "documents"), best.select(F.col("chunk_id").alias("doc_id")), "doc_id")
    linked = chunk.linked(chunk.fixed_windows(docs, 400, 80).select("doc_id", "chunk_index"))
    top = best.select("case_id", F.concat_ws(":", F.col("chunk_id").cast("string"), F.lit("0000")).alias("chunk_id"), "rank")
    return rank.expand_neighbors(top, linked).select("case_id", "chunk_id", F.col("side").cast("long").alias("side"), F.col("pos").cast("long").alias("pos"))


def source_packets(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d)
    packets = rank.source_packets(_boosted(spark, d, lists), rank.rrf(lists, 50))
    return packets.select("case_id", "source_id", "representative", F.array_join(F.transform("supporting", lambda x: x.cast("string")), ",").alias("supporting"))


def packet_order(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d)
    flat = rank.flatten_packets(rank.source_packets(_boosted(spark, d, lists), rank.rrf(lists, 50)))
    return flat.select("case_id", "chunk_id", F.col("pos").cast("long").alias("pos"))


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).withColumn("can_cite_clause", policy.can_cite_chunk(F.col("citation_role"), F.col("article_no")))


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = policy.filter_chunks(_meta(spark, d), equal={"law_status": "effective"}, any_of={"topic_tags": ["de", "t2"]}, is_true={"can_cite_clause": False})
    return rows.select("chunk_id", "source_id")


def clause_citable_filter(spark: SparkSession, d: str) -> DataFrame:
    return policy.clause_citable(_meta(spark, d)).select("chunk_id", "source_id", "article_no")


def citation_roles(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the role of their source, under a policy for the tables' sources."""
    roles = {"primary_legal_basis": ("src0", "src3"), "conditional_local_basis": ("src1", "src12"), "conditional_industry_basis": ("src5",), "implementation_reference": ("src7", "src8"), "interpretation_auxiliary": ()}
    rows = corpus(spark, d).withColumn("citation_role", policy.citation_role(F.col("source_id"), roles))
    rows = rows.select("citation_role", policy.can_cite_chunk(F.col("citation_role"), F.col("article_no")).alias("can_cite_clause"), policy.usage(F.col("citation_role")).alias("usage"))
    return rows.groupBy("citation_role", "usage", "can_cite_clause").agg(F.count("*").alias("n"))


def citation_groups(spark: SparkSession, d: str) -> DataFrame:
    hits = rank.rrf(_lists(spark, d), 20).select("case_id", "chunk_id", "rank").join(_meta(spark, d).select("chunk_id", "citation_role", "can_cite_clause", "applicable_region"), "chunk_id")
    return policy.citation_groups(hits)


def clean_control_and_space(spark: SparkSession, d: str) -> DataFrame:
    t = clean.simple_clean(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    """documents as an extractor might leave them: sentence ends as blank runs, commas as table dividers."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".  \n\n\n")), F.lit(", "), F.lit("\n|---|\n"))
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


def clean_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return clean.rule_hits(_dirty(spark, d)).select("doc_id", "rule", F.col("n").cast("long").alias("n"))


def rule_hit_totals(spark: SparkSession, d: str) -> DataFrame:
    return clean.rule_hits(_dirty(spark, d)).groupBy("rule").agg(F.sum("n").alias("n"))


def dedupe_title_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).select("doc_id", clean.drop_titles(F.col("text"), F.col("title")).alias("c"))
    return rows.select("doc_id", F.col("c.n").cast("long").alias("n_dropped"), F.md5("c.text").alias("digest"))


def ordered_clean_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.clean_documents(corpus(spark, d).select("doc_id", "title", "text"), F.col("title"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.to_json("cleaning_rule_hits").alias("hits"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    t = html_to_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


def line_pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk.line_chunks(table(spark, d, "documents"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk.chunk_documents(corpus(spark, d).select("doc_id", "source_id", "title", "text"))
    return rows.select("chunk_id", "prev_chunk_id", "next_chunk_id", F.col("char_count").cast("long").alias("n_chars"), F.size("heading_path").cast("long").alias("depth"), F.md5("citation_label").alias("label_digest"), "citation_role", "can_cite_clause")


def heading_units(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk.heading_units(table(spark, d, "documents"))
    return rows.select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), F.col("level").cast("long").alias("level"), "n_lines")


def faq_units(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as texts of questions (user turns) and answers, a line each, cut into their questions."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    line = F.when(F.col("role") == "user", F.concat(F.lit("问："), plain)).otherwise(plain)
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("t"))
    texts = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list("t")).alias("t")).select("doc_id", F.array_join("t.line", "\n").alias("text"))
    units = chunk.faq_units(texts)
    return units.select(F.col("doc_id").alias("conv_id"), F.col("unit_no").cast("long").alias("unit_no"), "question", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents that contain a benchmark passage; the first is a must, the others optional."""
    rows, q = corpus(spark, d), asked(spark, d)
    hits = phrase_pairs(rows, q, "text").join(rows.select("chunk_id", "source_id"), "chunk_id")
    gold = hits.select(F.col("query_id").alias("case_id"), "source_id").distinct()
    return materialize(gold.withColumn("must", F.row_number().over(Window.partitionBy("case_id").orderBy("source_id")) == 1), "gold")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    hits = materialize(rank.rrf(_lists(spark, d), 50).select("case_id", "chunk_id", "source_id", "rank"), "fused")
    q = asked(spark, d)
    cases = q.select(
        F.col("query_id").alias("case_id"), (F.col("query_id") % 10 == 9).alias("should_abstain"), F.lit(0.5).alias("min_recall"),
        F.when(F.col("query_id") % 10 >= 8, "insufficient_evidence").otherwise("medium").alias("risk_level"), F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("mode"),
    )
    return evaluate.case_metrics(cases, hits, _gold(spark, d))


def case_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    return m.select(
        "case_id", "recall_at_3", "recall_at_5", "mrr_at_10", "candidate_recall_at_50", "distinct_source_recall_at_5", "must_have_recall_at_5", "optional_coverage_at_5",
        F.col("duplicate_sources_at_10").cast("long").alias("duplicate_sources_at_10"), "abstention_correct", F.array_join("bad_categories", ",").alias("bad_categories"),
    )


def mode_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mode_metrics(_metrics(spark, d))


def bad_case_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.taxonomy_counts(_metrics(spark, d))


def span_overlap_eval(spark: SparkSession, d: str) -> DataFrame:
    rows, q = corpus(spark, d), asked(spark, d)
    pairs = phrase_pairs(rows, q, "text")
    own = pairs.join(rows.select("chunk_id", "text"), "chunk_id").join(q.withColumnRenamed("text", "q"), "query_id").withColumn("at", F.instr("text", F.col("q")) - 1).where("at >= 0")
    gold = own.select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("doc_id"), F.col("at").alias("g_start"), (F.col("at") + F.length("q")).alias("g_end"))
    gold = tables.first_seen(gold, ["case_id"], ["doc_id"])
    spans = _windows(spark, d).select("doc_id", "start", "end").join(gold.select("case_id", "doc_id"), "doc_id")
    spans = spans.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("start")))
    out = evaluate.span_overlap(gold, spans)
    return out.select("case_id", F.col("doc_rank").cast("long").alias("doc_rank"), F.col("span_rank").cast("long").alias("span_rank"), "best_overlap", "doc_hit_at_5", "span_hit_at_5")


def retrieval_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).select("chunk_id", "doc_id", "title", "article_no", F.when(F.col("doc_id") % 4 == 0, F.col("label")).alias("citation_label"), F.col("doc_id").alias("corpus_pos"))
    return evaluate.retrieval_cases(rows, 60)


def suite_cap(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.first_per_group(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5)


def governance_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.counts_by(_meta(spark, d), ["source_id", "lang", "citation_role", "law_status", "article_no"], ["topic_tags"])


def governance_report(spark: SparkSession, d: str) -> DataFrame:
    return report.rendered(report.counts_by(_meta(spark, d), ["lang", "law_status"])).select("dimension", "line", F.col("line_no").cast("long").alias("line_no"))


def heading_depth_hist(spark: SparkSession, d: str) -> DataFrame:
    """Depths of heading paths, of documents whose sentence ends and words in e stand for headings."""
    plain = F.replace(F.regexp_replace("text", "[^A-Za-z ]+", ". "), F.lit(". "), F.lit("\n## a"))
    docs = table(spark, d, "documents").select("doc_id", F.replace(plain, F.lit("e "), F.lit("\n### b")).alias("text"))
    hist = report.depth_histogram(chunk.heading_units(docs), "path_list")
    return hist.select(F.col("depth").cast("long").alias("depth"), "n")


def _materials(spark: SparkSession, d: str) -> DataFrame:
    """The user turns of every conversation as one material text."""
    rows = table(spark, d, "conversations").where("role = 'user'")
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return own.select(F.col("conv_id").alias("case_id"), F.array_join("t.text", "\n").alias("text"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return review.extract_facts(_materials(spark, d), ASCII)


def fact_extraction(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    return f.select(
        "case_id", F.array_join("data_types", ",").alias("data_types"), "sensitive_personal_info", "cross_border_transfer", "overseas_recipient", "processing_purpose", "legal_basis_or_consent", "industry", "region",
        F.array_join("missing_information", ",").alias("missing_information"),
    )


def _plan(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d).withColumn("question", F.concat(F.lit("case "), F.col("case_id").cast("string")))
    return review.plan_queries(facts, TEMPLATES, WORDS, ("keit", "ou"), ("th", "ch"))


def query_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


def query_plan_merge(spark: SparkSession, d: str) -> DataFrame:
    own = _plan(spark, d).withColumn("query_pos", F.substring("query_id", 3, 9).cast("int"))
    other = own.withColumn("text", F.concat(F.lit(" "), F.upper("text"))).unionByName(own.where("query_pos = 1").withColumn("text", F.lit("second opinion")).withColumn("query_pos", F.lit(99)))
    return review.merge_plans(own.withColumn("plan_pos", F.lit(0)).unionByName(other.withColumn("plan_pos", F.lit(1))))


def _case_facts(spark: SparkSession, d: str) -> DataFrame:
    missing = F.when(F.col("case_id") % 4 == 0, F.array(F.lit("overseas_recipient"))).otherwise(F.array().cast("array<string>"))
    f = _facts_by_case(spark, d).withColumn("missing_information", missing)
    return f.withColumnRenamed("cross_border", "cross_border_transfer").withColumn("data_types", F.array(F.lit("article"))).withColumn("sensitive_personal_info", F.col("case_id") % 5 == 0).withColumns({"processing_purpose": F.lit(None).cast("string"), "overseas_recipient": F.lit(None).cast("string")})


def _checked(spark: SparkSession, d: str) -> DataFrame:
    hits = materialize(rank.rrf(_lists(spark, d), 5).select("case_id", "chunk_id"), "first-hits")
    hits = hits.join(
        tables.among(_meta(spark, d), hits, "chunk_id").select("chunk_id", "citation_role", "can_cite_clause", "applicable_region", F.concat_ws(" ", "topic_tags").alias("subject_words"), "title", "text"), "chunk_id"
    )
    return review.self_check(_case_facts(spark, d), hits, ("the ", "der "), {"en": ("en",)})


def evidence_self_check(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("case_id", F.array_join("issues", ",").alias("issues"), "status")


def second_queries(spark: SparkSession, d: str) -> DataFrame:
    """The queries of the second pass."""
    plan = review.second_plan(_case_facts(spark, d), _checked(spark, d), {"数据出境": ("assessment", "transfer"), "安全评估": ("conditions", "assessment"), "个人信息": ("protection",), "en": ("english rules",), "负面清单": ("lists",), "跨境": ("abroad",)})
    return plan.select("case_id", "query_id", "query_type", "text", F.col("top_k").cast("long").alias("top_k"))


def second_pass(spark: SparkSession, d: str) -> DataFrame:
    return review.after_second(_checked(spark, d)).select("case_id", "status")


def boost_summary(spark: SparkSession, d: str) -> DataFrame:
    types = asked(spark, d).select(F.col("query_id").alias("case_id"), F.when(F.col("query_id") % 5 == 0, "missing_information").otherwise("legal_issue").alias("query_type"))
    out = rank.boost_summary(_facts_by_case(spark, d), types)
    return out.select("case_id", F.explode("boosts").alias("rule", "boost"))


def merged_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the user turns with gaps filled from those of the assistant turns."""
    turns = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    other = review.extract_facts(turns.select(F.col("conv_id").alias("case_id"), F.array_join("t.text", "\n").alias("text")), ASCII)
    f = review.merge_facts(_facts(spark, d), other)
    return f.select("case_id", F.array_join("data_types", ",").alias("data_types"), "overseas_recipient", "processing_purpose", "industry", "region", F.array_join("missing_information", ",").alias("missing_information"))


def review_routing(spark: SparkSession, d: str) -> DataFrame:
    """Which cases call for an analyst or a judgment beyond the rules."""
    f = _facts(spark, d).withColumn("question", F.lit("what applies"))
    return f.select("case_id", review.needs_analyst(("schst", "erheou")).alias("analyst"), review.needs_judgment().alias("judgment"))


def risk_decision(spark: SparkSession, d: str) -> DataFrame:
    own = _case_facts(spark, d).join(review.after_second(_checked(spark, d)), "case_id")
    return own.select("case_id", review.risk_level(("info",)).alias("risk_level"))


def review_results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows of all cases: risk, conclusion, reasons, actions and boundaries."""
    facts = _case_facts(spark, d).withColumn("legal_basis_or_consent", F.when(F.col("case_id") % 3 == 0, F.lit("agreed")))
    checks = review.after_second(_checked(spark, d)).withColumn("second_pass", F.col("case_id") % 7 == 0)
    cases = facts.join(checks, "case_id").withColumn("risk_level", review.risk_level(("info",)))
    hits = rank.rrf(_lists(spark, d), 5).select("case_id", "chunk_id", "rank")
    claims = review.rule_claims(cases.select("case_id", result.conclusion().alias("text")), hits)
    cited = hits.join(_meta(spark, d).select("chunk_id", policy.usage(F.col("citation_role")).alias("usage")), "chunk_id")
    out = result.review_results(cases, cited, claims)
    return out.select(
        "case_id", "risk_level", F.md5("conclusion").alias("conclusion"), F.array_join("trigger_reasons", ",").alias("trigger_reasons"), F.array_join("recommended_actions", ",").alias("recommended_actions"),
        F.array_join("risk_boundaries", ",").alias("risk_boundaries"), F.size("citations").cast("long").alias("n_citations"),
    )


def _review(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, workflow.Chunks]:
    """Planned queries, facts and chunks (of those that a table names) of the benchmark items as review cases."""
    facts = _case_facts(spark, d).join(asked(spark, d).select(F.col("query_id").alias("case_id"), F.col("text").alias("question"), F.col("text").alias("text")), "case_id")
    plan = review.plan_queries(facts, TEMPLATES, WORDS, ("en", "de"), ("th", "ch", "la")).withColumn("query_pos", F.substring("query_id", 3, 9).cast("int"))
    none = F.lit(None).cast("long")
    chunks = lambda named: tables.among(_meta(spark, d), named, "chunk_id").withColumns({
        "primary_like": F.col("citation_role") == "primary_legal_basis", "mentions": F.concat_ws(" ", "title", F.substring("text", 1, 500)), "subject_words": F.concat_ws(" ", "topic_tags"),
        "tokens": token_set(F.col("text")), "chunk_index": F.col("doc_id"), "prev_chunk_id": none, "next_chunk_id": none,
    })
    return plan, facts.drop("text", "question"), chunks


def keyword_review(spark: SparkSession, d: str) -> DataFrame:
    plan, _, _ = _review(spark, d)
    hits = workflow.keyword_retrieval(plan, lambda q, k: retrieve.keyword_search(corpus(spark, d), q, k, FIELDS), 10)
    return hits.select("case_id", "chunk_id", "score", "query_type", F.col("rank").cast("long").alias("rank"))


def _hybrid(spark: SparkSession, d: str, reranked: bool = False) -> workflow.Review:
    """Cases of the benchmark after keyword and semantic search, fusion, issues and at most one second pass; documents of neighbouring ids count as neighbours."""
    plan, facts, chunks = _review(spark, d)
    beside = {"prev_chunk_id": F.when(F.col("chunk_id") > 0, F.col("chunk_id") - 1), "next_chunk_id": F.col("chunk_id") + 1}
    rows = semantic_corpus(spark, d)
    searches = [retrieve.keyword_searcher(rows, FIELDS), retrieve.semantic_searcher(rows)]

    def title_scores(hits: DataFrame) -> DataFrame:
        t = tables.among(rows, hits, "chunk_id").select("chunk_id", token_set(F.col("title")).alias("t"))
        q = asked(spark, d).select(F.col("query_id").alias("case_id"), token_set(F.col("text")).alias("q"))
        return hits.join(t, "chunk_id").join(q, "case_id").select("case_id", "chunk_id", F.round(jaccard(F.col("q"), F.col("t")), 6).alias("rerank_score"))

    return workflow.hybrid_retrieval(
        plan, facts, lambda named: chunks(named).withColumns(beside), searches, evidence_terms=("the ", "der "), industries={"en": ("en",)}, expansions={"数据出境": ("que la", "der und"), "en": ("the of",)},
        options={"cross_border_terms": ("the", "der"), "industries": {"en": ("en",)}}, rerank_scores=title_scores if reranked else None,
    )


def hybrid_review(spark: SparkSession, d: str) -> DataFrame:
    r = _hybrid(spark, d)
    return r.hits.join(r.checks.select("case_id", "status"), "case_id").select("case_id", "chunk_id", "source_id", F.col("rank").cast("long").alias("rank"), "second_pass", "status")


def hybrid_packets(spark: SparkSession, d: str) -> DataFrame:
    """The packets of a reranked hybrid review, flattened: every chunk of evidence once, in order."""
    return rank.flatten_packets(_hybrid(spark, d, reranked=True).packets).select("case_id", "chunk_id", F.col("pos").cast("long").alias("pos"))


def claim_grounding(spark: SparkSession, d: str) -> DataFrame:
    hits = rank.rrf(_lists(spark, d), 10)
    texts = asked(spark, d).select(F.col("query_id").alias("case_id"), F.regexp_replace("text", r"\.", "!").alias("text"))
    claims = review.rule_claims(texts, hits)
    valid = review.valid_claims(claims, hits.select("case_id", "chunk_id").join(_meta(spark, d).where("citation_role <> 'interpretation_auxiliary'").select("chunk_id"), "chunk_id", "left_semi"))
    return valid.select("case_id", F.col("claim_pos").cast("long").alias("claim_pos"), F.array_join(F.transform("support", lambda x: x.cast("string")), ",").alias("support"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).withColumn("query_pos", F.substring("query_id", 3, 9).cast("int"))


def issue_plan(spark: SparkSession, d: str) -> DataFrame:
    out = review.issue_plan(_typed(spark, d))
    return out.select(
        "case_id", "issue_id", F.col("issue_pos").cast("long").alias("issue_pos"), "question", F.array_join("query_ids", ",").alias("query_ids"), F.array_join("query_types", ",").alias("query_types"), "priority"
    )


def _issue_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Issues of a case are the halves of its source numbers; a plan and pools over fused hits."""
    hits = rank.rrf(_lists(spark, d), 40).withColumn("query_id", F.when(F.col("chunk_id") % 2 == 0, "q_1").otherwise("q_2"))
    plan = asked(spark, d).select(F.col("query_id").alias("case_id"), F.explode(F.array(F.struct(F.lit("path").alias("i"), F.lit(1).alias("p"), F.array(F.lit("q_1")).alias("q"), F.lit("high").alias("h")), F.struct(F.lit("gaps").alias("i"), F.lit(2).alias("p"), F.array(F.lit("q_2"), F.lit("q_3")).alias("q"), F.lit("medium").alias("h")))).alias("x"))
    return plan.select("case_id", F.col("x.i").alias("issue_id"), F.col("x.p").alias("issue_pos"), F.col("x.q").alias("query_ids"), F.col("x.h").alias("priority")), hits


def dossiers(spark: SparkSession, d: str) -> DataFrame:
    plan, hits = _issue_hits(spark, d)
    out = review.dossiers(plan, hits)
    return out.select("case_id", "issue_id", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"), F.size("source_ids").cast("long").alias("n_sources"), "gap")


def issue_aware_select(spark: SparkSession, d: str) -> DataFrame:
    plan, hits = _issue_hits(spark, d)
    pools = hits.withColumn("issue_id", F.when(F.col("query_id") == "q_1", "path").otherwise("gaps"))
    return review.select_by_issue(plan, pools, hits, 10)


def latest_artifact(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def first_seen_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tables.first_seen(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    old, new = e.where("event_type <> 'purchase'").drop("event_type"), e.where("event_type in ('purchase', 'view')").drop("event_type").withColumn("value", F.col("value") + 1)
    return tables.upsert(old, new, "event_id").select("event_id", "user_id", F.round("value", 6).alias("value"))


def mock_embeddings(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d).select("query_id", mock_embedding(F.col("text"), 8).alias("v"))
    return q.select("query_id", F.posexplode("v").alias("i", "x")).select("query_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def latency_by_stage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.max("value"), 4).alias("max_value"), F.count_distinct("user_id").alias("n_users"))


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed_events(table(spark, d, "events"), "1 hour")


def sliding_events(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sliding_events(table(spark, d, "events"), "2 hours", "1 hour")


def session_events(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions(table(spark, d, "events"), "30 minutes")


def _event_trees(spark: SparkSession, d: str) -> DataFrame:
    """A JSON document of every user's events by type; those of an odd number of events are cut short, so they are no JSON."""
    e = table(spark, d, "events").withColumn("leaf", F.struct(F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"), F.col("props").alias("children")))
    of = lambda rows, key: F.transform(F.array_sort(F.collect_list(F.struct(key, rows))), lambda x: x[rows])
    by = e.groupBy("user_id", "event_type").agg(of("leaf", "event_id").alias("children"), F.count("*").alias("n"), F.min("ts").alias("first"))
    node = by.select("user_id", "n", "first", "event_type", F.struct(F.col("event_type").alias("title"), "children").alias("node"))
    users = node.groupBy("user_id").agg(of("node", "event_type").alias("children"), F.sum("n").alias("n"), F.min("first").alias("first"))
    payload = F.struct(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("title"), F.date_format("first", "yyyy-MM-dd").alias("gbrq"), F.struct(F.lit("events").alias("title"), "children").alias("content")
    )
    raw = F.to_json(F.struct(payload.alias("data")))
    return users.select("user_id", F.when(F.col("n") % 2 == 1, F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw).alias("raw"))


def json_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = _event_trees(spark, d).select("user_id", json_to_text(F.col("raw")).alias("text"))
    return rows.select("user_id", F.col("text").isNotNull().alias("parsed"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.md5("text").alias("digest"))


def file_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the tables as a raw file of some kind, and what its parser makes of it."""

    def files(name: str, stem: str, content: str, suffix: str) -> DataFrame:
        key = F.concat(F.lit(name + "-"), F.col(stem).cast("string"))
        return table(spark, d, name).select(key.alias("stem"), F.lit(suffix).alias("suffix"), F.concat(F.lit("raw/"), key, F.lit(suffix)).alias("path"), F.col(content).cast("binary").alias("content"))

    kinds = [("pages", "page_id", "html", ".html"), ("documents", "doc_id", "text", ".txt"), ("events", "event_id", "props", ".json"), ("benchmark", "item_id", "text", ".docx"), ("conversations", "conv_id", "text", ".pdf")]
    every, *more = (files(*k) for k in kinds)
    for m in more:
        every = every.unionByName(m)
    return parse.parse_files(every).select("path", "parser", F.md5("text").alias("digest"), "error", "hint")


def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("n_good"), F.sum("toxic").alias("n_toxic"))


_QUERIES = [
    normalize_text_stats, token_sets, keyword_topk, keyword_phrase_boost, field_weighted_search, semantic_overlap_topk, bm25_topk, bm25_fields_topk, vector_knn_cosine, vector_label_recall, vector_ivf_recall, multi_query_merge,
    rrf_fuse, rrf_fuse_many, metadata_boosts, source_aware_fuse, rerank_blend, fixed_window_chunks, chunk_links, neighbor_expansion, source_packets, packet_order, metadata_filter, clause_citable_filter,
    citation_roles, citation_groups, clean_control_and_space, clean_rule_hits, rule_hit_totals, dedupe_title_lines, ordered_clean_rules, html_text, line_pack_chunks, structured_chunks, heading_units,
    faq_units, case_metrics, mode_metrics, bad_case_taxonomy, span_overlap_eval, retrieval_cases, suite_cap, governance_counts, governance_report, heading_depth_hist, fact_extraction, query_plan,
    query_plan_merge, evidence_self_check, second_queries, second_pass, review_results, keyword_review, hybrid_review, hybrid_packets, boost_summary, merged_facts, review_routing, risk_decision, claim_grounding, issue_plan, dossiers, issue_aware_select, latest_artifact, first_seen_dedup, upsert_merge, mock_embeddings,
    latency_by_stage, windowed_events, sliding_events, session_events, label_agreement, json_documents, file_dispatch,
]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
