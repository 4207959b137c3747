"""DuckDB twins of the registered queries."""

from __future__ import annotations

from corpusloom.functions import rules

_NORM = r"lower(trim(regexp_replace({x}, '[^\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}A-Za-z0-9]+', ' ', 'g')))"
_SET = "list_distinct(regexp_extract_all(" + _NORM + ", '[a-z0-9]+'))"


def norm(x: str) -> str:
    return _NORM.format(x=x)


def tokens(x: str) -> str:
    return _SET.format(x=x)


_HTML = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?i)<br\s*/?>', E'\n', 'g'), '(?i)</(?:p|div|tr|li|h[1-6]|ul|ol|table)\s*>', E'\n', 'g'), '(?i)<(?:td|th)[^>]*>', '', 'g'), '(?i)</(?:td|th)\s*>', ' | ', 'g'), '<[^>]+>', '', 'g'),
 '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n\t\r' || chr(160))"""
_TITLE = r"trim(split_part(ltrim(text, E' \n\r\t'), E'\n', 1))"
_CORPUS = f"""
corpus AS (
  SELECT doc_id AS chunk_id, doc_id, source AS source_id, {_TITLE} AS title, text, source AS label, lang,
         CASE CAST(coalesce(nullif(regexp_extract(source, '([0-9]+)$', 1), ''), '0') AS INTEGER) % 5 WHEN 0 THEN 'primary_legal_basis' WHEN 1 THEN 'conditional_local_basis'
              WHEN 2 THEN 'conditional_industry_basis' WHEN 3 THEN 'implementation_reference' ELSE 'interpretation_auxiliary' END AS citation_role,
         CASE doc_id % 4 WHEN 0 THEN 'CN' WHEN 1 THEN 'CN-GD' WHEN 2 THEN 'CN-GD-SZ' ELSE 'CN-SH' END AS applicable_region,
         CASE WHEN doc_id % 7 = 0 THEN 'repealed' ELSE 'effective' END AS law_status,
         CASE WHEN doc_id % 3 = 0 THEN 'art' || (doc_id % 9) END AS article_no,
         [lang, 't' || (doc_id % 6)] AS topic_tags
  FROM documents
), meta AS (SELECT *, citation_role = 'primary_legal_basis' AND coalesce(article_no, '') <> '' AS can_cite_clause FROM corpus),
asked AS (SELECT item_id AS query_id, text FROM benchmark),
q AS (SELECT query_id, {tokens('text')} AS t, {norm('text')} AS q FROM asked),
qt AS (SELECT query_id, len(t) AS n, unnest(t) AS token FROM q)
"""


def _post(name: str, column: str) -> str:
    return f"{name} AS (SELECT chunk_id, unnest({tokens(column)}) AS token FROM corpus), {name}_n AS (SELECT query_id, chunk_id, count(*) AS hits, min(n) AS n FROM qt JOIN {name} USING (token) GROUP BY ALL)"


_PHRASE = "phrase AS (SELECT query_id, chunk_id FROM q JOIN (SELECT chunk_id, " + norm("text") + " AS body FROM corpus) ON length(q) >= 4 AND contains(body, q))"
_BODY, _TITLES = _post("body", "text"), _post("title_p", "title")
_TOP = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM {s} WHERE score > 0) WHERE rank < {k}"


def _bm25(name: str, column: str, weight: float) -> str:
    """name: the BM25 score of one field, weighted, for every pair that shares a token."""
    return f"""{name}_l AS (SELECT chunk_id, regexp_extract_all({norm(f"coalesce({column}, '')")}, '[a-z0-9]+') AS t FROM corpus), {name}_st AS (SELECT count(*) AS n_docs, sum(len(t)) AS all_len FROM {name}_l),
{name}_tf AS (SELECT chunk_id, len, token, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS token FROM {name}_l) GROUP BY ALL), {name}_df AS (SELECT token, count(*) AS df FROM {name}_tf GROUP BY token),
{name} AS (SELECT query_id, chunk_id, {weight}::DOUBLE * sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (all_len / n_docs)))) AS score
FROM qt JOIN {name}_tf USING (token) JOIN {name}_df USING (token), {name}_st GROUP BY ALL)"""


def _weighted(parts: list[tuple[str, float]], phrase: bool) -> str:
    """scored: sum of shares by field, in the order of the fields, and the phrase."""
    keys = " UNION ".join(f"SELECT query_id, chunk_id FROM {p}_n" for p, _ in parts) + (" UNION SELECT query_id, chunk_id FROM phrase" if phrase else "")
    joins = " ".join(f"LEFT JOIN {p}_n USING (query_id, chunk_id)" for p, _ in parts)
    total = " + ".join(f"coalesce({p}_n.hits, 0) / CAST(len(q.t) AS DOUBLE) * {w}" for p, w in parts)
    more = " + CASE WHEN phrase.query_id IS NOT NULL THEN 3.0 ELSE 0.0 END" if phrase else ""
    join = "LEFT JOIN phrase ON phrase.query_id = k.query_id AND phrase.chunk_id = k.chunk_id" if phrase else ""
    return f"scored AS (SELECT query_id, chunk_id, {total}{more} AS score FROM ({keys}) k JOIN q USING (query_id) {joins} {join})"


_LISTS = f"""
{_BODY}, {_TITLES},
l0 AS ({_TOP.format(s='(SELECT query_id, chunk_id, hits / CAST(n AS DOUBLE) AS score FROM body_n)', k=50)}),
l1 AS ({_TOP.format(s='(SELECT query_id, chunk_id, hits / CAST(n AS DOUBLE) AS score FROM title_p_n)', k=50)}),
lists AS (SELECT query_id AS case_id, chunk_id, score, rank, 0 AS list_id, source_id FROM l0 JOIN corpus USING (chunk_id)
          UNION ALL SELECT query_id, chunk_id, score, rank, 1, source_id FROM l1 JOIN corpus USING (chunk_id))
"""


def _rrf(source: str, k: int, name: str = "fused") -> str:
    return f"""{name}_p AS (SELECT *, row_number() OVER (PARTITION BY case_id, list_id ORDER BY score DESC, chunk_id) - 1 AS r FROM {source}),
{name}_s AS (SELECT case_id, chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS s, any_value(source_id) AS source_id, count(*) AS n_lists FROM {name}_p GROUP BY case_id, chunk_id),
{name} AS (SELECT * FROM (SELECT case_id, chunk_id, source_id, n_lists, round(s, 6) AS score, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, chunk_id) - 1 AS rank FROM {name}_s) WHERE rank < {k})"""


_BASE = f"WITH {_CORPUS}, {_LISTS}"
_SOURCES = f"""{_rrf('lists', 50)},
typed AS (SELECT *, CASE WHEN chunk_id % 4 = 0 THEN 'missing_information' ELSE 'material_fact' END AS query_type FROM fused),
placed AS (SELECT t.*, {tokens('c.text')} AS tokens, c.doc_id, c.article_no, row_number() OVER (PARTITION BY case_id, t.source_id ORDER BY score DESC, rank, chunk_id) AS p FROM typed t JOIN corpus c USING (chunk_id)),
rep AS (SELECT * FROM placed WHERE p = 1),
sup AS (SELECT s.case_id, s.source_id, s.score, s.p, coalesce(s.article_no = r.article_no AND s.article_no <> '', false) OR abs(s.doc_id - r.doc_id) <= 1 AS related,
               CASE WHEN len(s.tokens) = 0 OR len(r.tokens) = 0 THEN 0 ELSE len(list_intersect(s.tokens, r.tokens)) / CAST(len(s.tokens) + len(r.tokens) - len(list_intersect(s.tokens, r.tokens)) AS DOUBLE) END AS j
        FROM placed s JOIN rep r ON s.case_id = r.case_id AND s.source_id = r.source_id WHERE s.p > 1),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, source_id ORDER BY p) AS n FROM sup WHERE j < 0.82) WHERE n <= 2),
added AS (SELECT case_id, source_id, sum(score * CASE WHEN related THEN 0.45::DOUBLE ELSE 0.35::DOUBLE END) AS added, count(*) AS n_supports FROM two GROUP BY ALL),
sources AS (SELECT rep.case_id, rep.source_id, chunk_id, round((rep.score + coalesce(added, 0)) * CASE WHEN query_type = 'missing_information' THEN 0.7::DOUBLE ELSE 1.05::DOUBLE END, 6) AS score, coalesce(n_supports, 0) AS n_supports
            FROM rep LEFT JOIN added ON rep.case_id = added.case_id AND rep.source_id = added.source_id),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, source_id) - 1 AS rank FROM sources) WHERE rank < 10)"""
_GOLD = """gold AS (SELECT case_id, source_id, row_number() OVER (PARTITION BY case_id ORDER BY source_id) = 1 AS must
         FROM (SELECT DISTINCT query_id AS case_id, source_id FROM phrase JOIN corpus USING (chunk_id)))"""


def _recall(name: str, hits: str, k: int, where: str = "true") -> str:
    return f"{name} AS (SELECT g.case_id, round(count(h.source_id) / CAST(count(*) AS DOUBLE), 4) AS v FROM gold g LEFT JOIN (SELECT DISTINCT case_id, source_id FROM {hits} WHERE rank < {k}) h ON g.case_id = h.case_id AND g.source_id = h.source_id WHERE {where} GROUP BY g.case_id)"


_METRICS = f"""{_BASE}, {_PHRASE}, {_GOLD}, {_rrf('lists', 50)},
firsts AS (SELECT case_id, source_id, row_number() OVER (PARTITION BY case_id ORDER BY min(rank)) - 1 AS rank FROM fused GROUP BY case_id, source_id),
{_recall('r3', 'fused', 3)}, {_recall('r5', 'fused', 5)}, {_recall('c50', 'fused', 50)}, {_recall('d5', 'firsts', 5)}, {_recall('m5', 'fused', 5, 'must')}, {_recall('o5', 'fused', 5, 'NOT must')},
mrr AS (SELECT g.case_id, round(coalesce(max(1.0::DOUBLE / (rank + 1)), 0), 4) AS v FROM gold g LEFT JOIN (SELECT * FROM fused WHERE rank < 10) h ON g.case_id = h.case_id AND g.source_id = h.source_id GROUP BY g.case_id),
dup AS (SELECT case_id, count(*) - count(DISTINCT source_id) AS v FROM fused WHERE rank < 10 GROUP BY case_id),
cases AS (SELECT query_id AS case_id, query_id % 10 = 9 AS should_abstain, CASE WHEN query_id % 10 >= 8 THEN 'insufficient_evidence' ELSE 'medium' END AS risk_level, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS mode FROM asked),
joined AS (SELECT c.*, r3.v AS recall_at_3, r5.v AS recall_at_5, mrr.v AS mrr_at_10, c50.v AS candidate_recall_at_50, d5.v AS distinct_source_recall_at_5, m5.v AS must_have_recall_at_5, o5.v AS optional_coverage_at_5,
                  coalesce(dup.v, 0) AS duplicate_sources_at_10, should_abstain = (risk_level = 'insufficient_evidence') AS abstention_correct
           FROM cases c LEFT JOIN r3 USING (case_id) LEFT JOIN r5 USING (case_id) LEFT JOIN mrr USING (case_id) LEFT JOIN c50 USING (case_id) LEFT JOIN d5 USING (case_id) LEFT JOIN m5 USING (case_id) LEFT JOIN o5 USING (case_id) LEFT JOIN dup USING (case_id)),
graded AS (SELECT *, concat_ws(',', CASE WHEN recall_at_5 IS NOT NULL AND NOT should_abstain THEN CASE WHEN recall_at_5 = 0 THEN 'retrieval_zero_recall' WHEN recall_at_5 < 0.5 THEN 'retrieval_low_recall' END END,
                  CASE WHEN recall_at_5 IS NOT NULL AND NOT should_abstain AND candidate_recall_at_50 < 0.5 THEN 'candidate_missing' END, CASE WHEN NOT abstention_correct THEN 'abstention_error' END) AS bad_categories FROM joined)"""
_MEANS = ", ".join(
    f"round(avg({c}), 4) AS mean_{c}"
    for c in ("recall_at_3", "recall_at_5", "mrr_at_10", "candidate_recall_at_50", "distinct_source_recall_at_5", "must_have_recall_at_5", "optional_coverage_at_5", "duplicate_sources_at_10")
)
_WINDOWS = "win AS (SELECT doc_id, (s // 320) AS chunk_index, s AS start, least(s + 400, length(text)) AS \"end\", substr(text, s + 1, 400) AS body FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 81, 0) + 1, 320)) AS s FROM documents WHERE length(text) > 0))"
_LINKED = "linked AS (SELECT doc_id, chunk_index, doc_id || ':' || lpad(CAST(chunk_index AS VARCHAR), 4, '0') AS chunk_id FROM win), links AS (SELECT *, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM linked WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))"
_CLEAN = r"regexp_replace(text, '\r\n?', E'\n', 'g')"
_RULE_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(line, '{p}')" + (f" OR regexp_matches(trim(line, '[]()'), '{rules.SOURCE_URL}')" if n == "standalone_source_url_lines" else "") + f" THEN '{n}'" for n, p in rules.MECHANICAL.items()
) + " END"
_RULE_HITS = rf"""dirty AS (SELECT doc_id, replace(replace(text, '. ', E'.  \n\n\n'), ', ', E'\n|---|\n') AS text FROM documents), hits AS (
  SELECT doc_id, 'control_chars' AS rule, len(regexp_extract_all({_CLEAN}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) AS n FROM dirty
  UNION ALL SELECT doc_id, 'trailing_space', len(regexp_extract_all({_CLEAN}, '[ \t]+\n')) FROM dirty
  UNION ALL SELECT doc_id, 'blank_lines', len(regexp_extract_all({_CLEAN}, '\n{{3,}}')) FROM dirty
  UNION ALL SELECT doc_id, {_RULE_CASE}, count(*) FROM (SELECT doc_id, trim(unnest(string_split({_CLEAN}, E'\n')), E' \t\r\f') AS line FROM dirty) GROUP BY ALL)"""
_MATERIAL = "m AS (SELECT conv_id AS case_id, string_agg(coalesce(text, ''), E'\\n' ORDER BY turn, coalesce(text, '')) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)"
_FACTS = rf"""{_MATERIAL}, f0 AS (
  SELECT case_id, text, CASE WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'eaux') THEN 'eaux' WHEN contains(text, 'ung') THEN 'ung' END AS overseas_recipient FROM m
), f1 AS (
  SELECT case_id, text, overseas_recipient,
         list_distinct(list_filter([CASE WHEN contains(text, 'the') THEN 'article' END, CASE WHEN contains(text, 'der') THEN 'article' END, CASE WHEN contains(text, 'que') THEN 'pronoun' END, CASE WHEN contains(text, 'en') THEN 'preposition' END], lambda x: x IS NOT NULL)) AS dt,
         CASE WHEN contains(text, 'erheou') OR contains(text, 'schst') THEN true END AS sensitive_personal_info,
         CASE WHEN contains(text, 'export') OR contains(text, 'abroad') OR regexp_matches(substr(text, greatest(instr(text, overseas_recipient) - 12, 1), instr(text, overseas_recipient) - greatest(instr(text, overseas_recipient) - 12, 1) + length(overseas_recipient) + 18), 'send|transfer') THEN true END AS cross_border_transfer,
         CASE WHEN contains(text, 'for') THEN 'for' WHEN contains(text, 'pour') THEN 'pour' WHEN contains(text, 'para') THEN 'para' END AS processing_purpose,
         CASE WHEN contains(regexp_replace(text, '(not|no)[^，。；,;：:]{{0,4}}and', ' ', 'g'), 'and') OR contains(text, 'und') THEN 'agreed' END AS consent0,
         CASE WHEN contains(text, 'ingth') THEN 'ingth' WHEN contains(text, 'heit') THEN 'heit' WHEN contains(text, 'mente') THEN 'mente' END AS industry,
         CASE WHEN contains(text, 'ouer') THEN 'ouer' WHEN contains(text, 'keit') THEN 'keit' END AS region,
         contains(text, 'th') OR contains(text, 'ch') OR regexp_matches(text, '[0-9]+\s*[万亿千百十]') AS has_volume
  FROM f0
)"""
_CASE_FACTS = """cf AS (SELECT query_id AS case_id, query_id % 2 = 0 AS cross_border, CASE query_id % 3 WHEN 0 THEN '广东' WHEN 1 THEN '上海' END AS region, CASE query_id % 3 WHEN 0 THEN 'CN-GD' WHEN 1 THEN 'CN-SH' END AS code,
 CASE WHEN query_id % 2 = 1 THEN 'en' END AS industry, query_id % 4 = 0 AS critical, query_id % 5 = 0 AS sensitive FROM asked)"""
_CHECK = f"""{_BASE}, {_CASE_FACTS}, {_rrf('lists', 5)},
told AS (SELECT cf.case_id, coalesce(bool_or(citation_role = 'primary_legal_basis' AND can_cite_clause), false) AS prim, coalesce(bool_or(applicable_region = code OR applicable_region = region), false) AS loc,
                coalesce(bool_or(CASE WHEN industry = 'en' THEN contains(array_to_string(topic_tags, ' '), 'en') ELSE false END), false) AS ind,
                coalesce(bool_or(citation_role IN ('primary_legal_basis', 'conditional_local_basis', 'conditional_industry_basis')), false) AS binding,
                coalesce(bool_or(contains(text || title, 'the ') OR contains(text || title, 'der ')), false) AS border, count(citation_role) AS n
         FROM cf LEFT JOIN fused USING (case_id) LEFT JOIN meta USING (chunk_id) GROUP BY cf.case_id),
issues AS (SELECT cf.*, prim, concat_ws(',', CASE WHEN NOT prim THEN 'no_primary_legal_basis' END, CASE WHEN region IS NOT NULL AND NOT loc THEN 'region_mismatch' END, CASE WHEN industry IS NOT NULL AND NOT ind THEN 'industry_mismatch' END,
                  CASE WHEN n > 0 AND NOT binding THEN 'only_auxiliary_evidence' END, CASE WHEN cross_border AND NOT border THEN 'cross_border_mismatch' END, CASE WHEN critical THEN 'critical_facts_missing' END) AS issues
           FROM cf JOIN told USING (case_id)),
checked AS (SELECT *, CASE WHEN replace(issues, 'critical_facts_missing', '') <> '' THEN 'needs_second_retrieval' ELSE 'sufficient' END AS status FROM issues),
after AS (SELECT *, CASE WHEN status <> 'needs_second_retrieval' THEN status WHEN prim THEN 'sufficient' ELSE 'insufficient' END AS verdict FROM checked)"""
_ISSUES = f"""{_BASE}, {_rrf('lists', 40)}, hits AS (SELECT *, CASE WHEN chunk_id % 2 = 0 THEN 'path' ELSE 'gaps' END AS issue_id FROM fused),
plan AS (SELECT query_id AS case_id, unnest(['path', 'gaps']) AS issue_id FROM asked)"""

_LINES = r"""ln AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n?|[\n\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\x0B\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+|[\s\x0B\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+$', '', 'g')), lambda x: x <> '' AND lower(x) NOT IN ('<!-- image -->', '<!--image-->')) AS ls FROM documents),
lv AS (SELECT doc_id, i, line, CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN length(regexp_extract(line, '^(#+)', 1)) WHEN regexp_matches(line, '^\d+(?:\.\d+){0,4}[.、]?\s+[^。]{1,80}$') THEN least(6, length(regexp_extract(line, '^(\d+(?:\.\d+){0,4})', 1)) - length(replace(regexp_extract(line, '^(\d+(?:\.\d+){0,4})', 1), '.', '')) + 1)
 WHEN regexp_matches(line, '^[一二三四五六七八九十]+、.{1,80}$') THEN 1 WHEN regexp_matches(line, '^（[一二三四五六七八九十]+）.{1,80}$') THEN 2 WHEN starts_with(line, '行业领域') AND length(line) <= 80 THEN 1 END AS level
 FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM ln))"""
_PLAN = f"""{_FACTS}, f2 AS (SELECT *, 'case ' || case_id AS question, 'case ' || case_id || ' ' || text AS ctx, coalesce(cross_border_transfer, false) AS abroad, list_filter(['article', 'pronoun', 'preposition'], lambda x: list_contains(dt, x)) AS types,
 concat_ws(' ', CASE WHEN cross_border_transfer AND overseas_recipient IS NULL THEN 'overseas_recipient' END, CASE WHEN consent0 IS NULL THEN 'legal_basis_or_consent' END, CASE WHEN cross_border_transfer AND NOT has_volume THEN 'data_volume_threshold' END, CASE WHEN processing_purpose IS NULL THEN 'processing_purpose' END, CASE WHEN len(dt) = 0 THEN 'data_types' END) AS missing FROM f1),
raw AS (
 SELECT case_id, 0 AS pos, 'legal_issue' AS query_type, question AS text FROM f2
 UNION ALL SELECT case_id, 1, 'material_fact', concat_ws(' ', CASE WHEN abroad THEN 'export' END, nullif(array_to_string(types, ' '), ''), overseas_recipient, CASE WHEN sensitive_personal_info THEN 'sensitive' END) FROM f2 WHERE abroad OR len(types) > 0 OR overseas_recipient IS NOT NULL OR sensitive_personal_info
 UNION ALL SELECT case_id, 2, 'region_condition', region || ' list' FROM f2 WHERE region IS NOT NULL AND (contains(ctx, 'keit') OR contains(ctx, 'ou'))
 UNION ALL SELECT case_id, 3, 'industry_condition', industry || CASE WHEN abroad THEN ' export' ELSE ' security' END || ' rules' FROM f2 WHERE industry IS NOT NULL AND (contains(ctx, 'th') OR contains(ctx, 'ch'))
 UNION ALL SELECT case_id, 4, 'legal_issue', 'assessment conditions' FROM f2 WHERE contains(ctx, 'tion') OR contains(ctx, 'heit')
 UNION ALL SELECT case_id, 5, 'legal_issue', 'standard contract' FROM f2 WHERE contains(ctx, 'er') AND abroad AND contains(ctx, 'th')
 UNION ALL SELECT case_id, 6, 'missing_information', missing FROM f2 WHERE missing <> ''
), planned AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS qpos, query_type, text FROM raw)"""

ORACLES = {
    "dedupe_title_lines": f"""WITH {_CORPUS}, l AS (SELECT doc_id, title, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM corpus), st AS (SELECT *, trim(line, E' \\t\\r\\f') AS stripped FROM l),
n AS (SELECT *, stripped = title AND title <> '' AND row_number() OVER (PARTITION BY doc_id, stripped = title ORDER BY i) > 1 AS again FROM st)
SELECT doc_id, count(*) FILTER (again) AS n_dropped, md5(coalesce(string_agg(line, E'\\n' ORDER BY i) FILTER (NOT again), '')) AS digest FROM n GROUP BY doc_id""",
    "heading_depth_hist": r"""WITH l AS (SELECT doc_id, unnest(string_split(t, E'\n')) AS line, generate_subscripts(string_split(t, E'\n'), 1) AS i
  FROM (SELECT doc_id, replace(replace(regexp_replace(text, '[^A-Za-z ]+', '. ', 'g'), '. ', E'\n## a'), 'e ', E'\n### b') AS t FROM documents)),
n AS (SELECT doc_id, i, CASE WHEN starts_with(line, '### ') THEN 3 WHEN starts_with(line, '## ') THEN 2 END AS level FROM l WHERE trim(line) <> ''),
h AS (SELECT *, CASE level WHEN 2 THEN 1 WHEN 3 THEN 1 + CAST(bool_or(level = 2) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INTEGER) ELSE 0 END AS depth,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) AS first FROM n)
SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM h WHERE level IS NOT NULL OR first = 1 GROUP BY depth""",
    "line_pack_chunks": f"""WITH {_LINES}, p AS (SELECT doc_id, list_transform(flatten(list_transform(ls, lambda x: CASE WHEN length(x) > 650 THEN list_transform(range(0, length(x), 480), lambda s: 'C' || substr(x, s + 1, 480)) ELSE ['O' || x] END)), lambda y: [y]) AS ps FROM ln),
r AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE WHEN a[-1][1] = 'O' AND x[1][1] = 'O' AND length(a[-1]) + length(x[1]) - 1 <= 650 THEN list_concat(a[:-2], [a[-1] || chr(10) || substr(x[1], 2)]) ELSE list_concat(a, x) END) AS us FROM p WHERE len(ps) > 0),
u AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) - 1 AS chunk_index FROM r)
SELECT doc_id, chunk_index, length(u) - 1 AS n_chars, md5(substr(u, 2)) AS digest FROM u""",
    "heading_units": f"WITH {_LINES}, u AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM lv) SELECT doc_id, CAST(k AS BIGINT) AS unit_no, CAST(max(level) AS BIGINT) AS level, count(*) AS n_lines FROM u GROUP BY doc_id, k",
    "query_plan": f"WITH {_PLAN} SELECT case_id, 'q_' || qpos AS query_id, query_type, text FROM planned",
    "query_plan_merge": f"""WITH {_PLAN}, every AS (SELECT case_id, 0 AS plan_pos, qpos, query_type, text FROM planned UNION ALL SELECT case_id, 1, qpos, query_type, ' ' || upper(text) FROM planned UNION ALL SELECT case_id, 1, 99, query_type, 'second opinion' FROM planned WHERE qpos = 1),
one AS (SELECT *, row_number() OVER (PARTITION BY case_id, query_type, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY plan_pos, qpos) AS n FROM every)
SELECT case_id, 'q_' || row_number() OVER (PARTITION BY case_id ORDER BY plan_pos, qpos) AS query_id, query_type, text FROM one WHERE n = 1""",
    "issue_plan": f"""WITH {_PLAN}, g AS (SELECT *, CASE WHEN query_type IN ('legal_issue', 'material_fact') THEN 0 WHEN query_type = 'region_condition' THEN 1 WHEN query_type = 'industry_condition' THEN 2 ELSE 3 END AS grp FROM planned),
t AS (SELECT case_id, grp, query_type, min(qpos) AS first FROM g GROUP BY ALL), ty AS (SELECT case_id, grp, string_agg(query_type, ',' ORDER BY first) AS query_types FROM t GROUP BY ALL),
a AS (SELECT case_id, grp, string_agg('q_' || qpos, ',' ORDER BY qpos) AS query_ids, string_agg(text, '；' ORDER BY qpos) AS texts FROM g GROUP BY ALL)
SELECT case_id, 'issue_' || p AS issue_id, p AS issue_pos, ['核心法律问题', '地区适用条件', '行业适用条件', '关键缺失信息'][grp + 1] || '：' || texts AS question, query_ids, query_types, CASE WHEN grp = 0 THEN 'high' ELSE 'medium' END AS priority
FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grp) AS p FROM a JOIN ty USING (case_id, grp))""",
    "issue_aware_select": f"""WITH RECURSIVE {_BASE.removeprefix('WITH ')}, {_rrf('lists', 40)},
o AS (SELECT case_id, list({{'c': chunk_id, 's': source_id}} ORDER BY rank) AS g, list({{'c': chunk_id, 's': source_id}} ORDER BY score DESC, rank, chunk_id) AS b,
             list({{'c': chunk_id, 's': source_id}} ORDER BY score DESC, rank, chunk_id) FILTER (chunk_id % 2 = 0) AS p, list({{'c': chunk_id, 's': source_id}} ORDER BY score DESC, rank, chunk_id) FILTER (chunk_id % 2 <> 0) AS q FROM fused GROUP BY case_id),
sel(case_id, step, cs, ss) AS (
  SELECT case_id, 0, []::BIGINT[], []::VARCHAR[] FROM o
  UNION ALL
  SELECT case_id, step + 1, CASE WHEN x IS NULL THEN cs ELSE list_append(cs, x.c) END, CASE WHEN x IS NULL THEN ss ELSE list_append(ss, x.s) END
  FROM (SELECT sel.*, CASE WHEN len(cs) >= 10 THEN NULL ELSE coalesce(list_filter(l, lambda y: NOT list_contains(cs, y.c) AND NOT list_contains(ss, y.s))[1], list_filter(l, lambda y: NOT list_contains(cs, y.c))[1]) END AS x
        FROM (SELECT sel.*, CASE WHEN step < 3 THEN g[step + 1 : step + 1] WHEN step = 3 THEN coalesce(p, []) WHEN step < 14 THEN b WHEN step = 14 THEN coalesce(p, []) ELSE coalesce(q, []) END AS l FROM sel JOIN o USING (case_id) WHERE step < 16) sel)
)
SELECT case_id, unnest(cs) AS chunk_id, CAST(generate_subscripts(cs, 1) AS INTEGER) AS rank FROM sel WHERE step = 16""",
    "normalize_text_stats": f"SELECT doc_id, length(n) AS n_chars, len(regexp_extract_all(n, '[a-z0-9]+')) AS n_tokens, md5(n) AS digest FROM (SELECT doc_id, {norm('text')} AS n FROM documents)",
    "token_sets": f"SELECT token, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents) GROUP BY token",
    "keyword_topk": f"WITH {_CORPUS}, {_BODY}, {_TITLES}, {_PHRASE}, {_weighted([('body', 1.0), ('title_p', 2.5)], True)} {_TOP.format(s='scored', k=10)}",
    "keyword_phrase_boost": f"WITH {_CORPUS}, {_BODY}, {_PHRASE}, {_weighted([('body', 1.0)], True)} SELECT query_id, chunk_id, round(score, 6) AS score FROM scored WHERE score >= 3",
    "field_weighted_search": f"WITH {_CORPUS}, {_BODY}, {_TITLES}, {_post('label_p', 'label')}, {_post('head_p', 'lang')}, {_weighted([('body', 1.0), ('title_p', 2.5), ('label_p', 2.0), ('head_p', 1.5)], False)} {_TOP.format(s='scored', k=10)}",
    "semantic_overlap_topk": f"""WITH {_CORPUS}, {_post('sem_p', "concat_ws(' ', text, title, array_to_string(topic_tags, ' '), lang, applicable_region, law_status, title, source_id, label, article_no)")}, {_TITLES}, {_post('tag_p', "array_to_string(topic_tags, ' ')")}, {_weighted([('sem_p', 1.0), ('title_p', 0.5), ('tag_p', 0.3)], False)} {_TOP.format(s='scored', k=10)}""",
    "bm25_topk": f"WITH {_CORPUS}, {_bm25('b', 'text', 1)} SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM ({_TOP.format(s='(SELECT query_id, chunk_id, round(score, 6) AS score FROM b)', k=10)})",
    "bm25_fields_topk": f"""WITH {_CORPUS}, {_bm25('b1', 'title', 2)}, {_bm25('b2', 'label', 2)}, {_bm25('b3', 'lang', 1)}, {_bm25('b4', 'text', 1)}, {_bm25('b5', "array_to_string(topic_tags, ' ')", 1)},
every AS (SELECT query_id, chunk_id, round(max(score), 6) AS score FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4 UNION ALL SELECT * FROM b5) GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM ({_TOP.format(s='every', k=10)})""",
    "vector_knn_cosine": """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id,
 round(list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank < 10""",
    "vector_label_recall": """WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, a.label AS own, b.label,
 round(list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank < 10)
SELECT query_id, count(*) FILTER (label = own) AS n_same, min(CASE WHEN label = own THEN rank END) AS first_same FROM h GROUP BY query_id""",
    "multi_query_merge": f"{_BASE}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, chunk_id ORDER BY score DESC, list_id) AS n FROM lists) WHERE n = 1) SELECT case_id, chunk_id, score, CAST(list_id AS BIGINT) AS query_pos, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_id) - 1 AS r FROM b) WHERE r < 20",
    "rrf_fuse": f"{_BASE}, {_rrf('lists', 20)} SELECT case_id, chunk_id, score, n_lists, rank FROM fused",
    "rrf_fuse_many": f"{_BASE}, {_PHRASE}, {_post('label_p', 'label')}, {_weighted([('body', 1.0), ('title_p', 2.5), ('label_p', 2.0)], True)}, l2 AS ({_TOP.format(s='scored', k=50)}), every AS (SELECT case_id, chunk_id, score, source_id, list_id FROM lists UNION ALL SELECT query_id, chunk_id, l2.score, source_id, 2 FROM l2 JOIN corpus USING (chunk_id)), {_rrf('every', 20)} SELECT case_id, chunk_id, score, n_lists, rank FROM fused",
    "metadata_boosts": f"""{_BASE}, {_CASE_FACTS}, b AS (SELECT case_id, chunk_id, score,
 (CASE WHEN citation_role = 'primary_legal_basis' THEN CASE WHEN cross_border AND (contains(title || ' ' || substr(text, 1, 500), 'the') OR contains(title || ' ' || substr(text, 1, 500), 'der')) THEN 1.2::DOUBLE * 1.25::DOUBLE ELSE 1.2::DOUBLE END ELSE 1.0::DOUBLE END)
 * (CASE WHEN citation_role = 'conditional_local_basis' AND region IS NOT NULL THEN CASE WHEN applicable_region <> 'CN' AND (applicable_region = code OR starts_with(applicable_region, code || '-') OR starts_with(code, applicable_region || '-')) THEN 1.5::DOUBLE ELSE 0.45::DOUBLE END ELSE 1.0::DOUBLE END)
 * (CASE WHEN citation_role = 'conditional_industry_basis' AND industry IS NOT NULL THEN CASE WHEN contains(array_to_string(topic_tags, ' '), 'en') THEN 1.4::DOUBLE ELSE 0.75::DOUBLE END ELSE 1.0::DOUBLE END)
 * (CASE WHEN citation_role = 'implementation_reference' AND chunk_id % 5 = 0 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN citation_role = 'interpretation_auxiliary' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN chunk_id % 5 = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) AS boost
 FROM lists JOIN corpus USING (chunk_id) JOIN cf USING (case_id) WHERE list_id = 0) SELECT case_id, chunk_id, round(boost, 6) AS boost, round(score * boost + 1e-9::DOUBLE, 6) AS score FROM b""",
    "source_aware_fuse": f"{_BASE}, {_SOURCES} SELECT case_id, source_id, chunk_id, score, n_supports, rank FROM final",
    "rerank_blend": f"""{_BASE}, {_rrf('lists', 50)}, tt AS (SELECT chunk_id, {tokens('title')} AS t FROM corpus),
s AS (SELECT f.*, round(CASE WHEN len(tt.t) = 0 OR len(q.t) = 0 THEN 0 ELSE len(list_intersect(q.t, tt.t)) / CAST(len(q.t) + len(tt.t) - len(list_intersect(q.t, tt.t)) AS DOUBLE) END, 6) AS rr FROM fused f JOIN tt USING (chunk_id) JOIN q ON q.query_id = f.case_id),
w AS (SELECT *, min(score) OVER c AS lo, max(score) OVER c AS hi, min(rr) OVER c AS rlo, max(rr) OVER c AS rhi FROM s WINDOW c AS (PARTITION BY case_id)),
b AS (SELECT case_id, chunk_id, rank AS old, round(0.6::DOUBLE * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END + 0.4::DOUBLE * CASE WHEN rr IS NULL THEN 0.0 WHEN rhi = rlo THEN 1.0 ELSE (rr - rlo) / (rhi - rlo) END, 6) AS score FROM w)
SELECT case_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, old) - 1 AS rank FROM b) WHERE rank < 20""",
    "fixed_window_chunks": f'WITH {_WINDOWS} SELECT doc_id, chunk_index, start, "end", md5(body) AS digest FROM win',
    "chunk_links": f"WITH {_WINDOWS}, {_LINKED} SELECT chunk_id, prev_chunk_id, next_chunk_id FROM links",
    "neighbor_expansion": f"""{_BASE}, {_SOURCES}, {_WINDOWS}, {_LINKED}, top AS (SELECT case_id, chunk_id || ':0000' AS chunk_id, rank FROM final),
sides AS (SELECT case_id, rank AS hit_pos, 0 AS side, prev_chunk_id AS chunk_id FROM top JOIN links USING (chunk_id) UNION ALL SELECT case_id, rank, 1, next_chunk_id FROM top JOIN links USING (chunk_id)),
one AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY case_id, chunk_id ORDER BY hit_pos, side) AS n FROM sides s WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM top t WHERE t.case_id = s.case_id AND t.chunk_id = s.chunk_id)) WHERE n = 1)
SELECT case_id, chunk_id, CAST(-(side + 1) AS BIGINT) AS side, pos FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY hit_pos, side) - 1 AS pos FROM one) WHERE pos < 10""",
    "source_packets": f"""{_BASE}, {_SOURCES}, rest AS (SELECT f.case_id, f.source_id, f.chunk_id, row_number() OVER (PARTITION BY f.case_id, f.source_id ORDER BY f.rank, f.score DESC, f.chunk_id) AS n FROM fused f JOIN final x ON f.case_id = x.case_id AND f.source_id = x.source_id AND f.chunk_id <> x.chunk_id)
SELECT x.case_id, x.source_id, x.chunk_id AS representative, coalesce(string_agg(CAST(r.chunk_id AS VARCHAR), ',' ORDER BY n), '') AS supporting FROM final x LEFT JOIN (SELECT * FROM rest WHERE n <= 2) r ON x.case_id = r.case_id AND x.source_id = r.source_id GROUP BY ALL""",
    "packet_order": f"""{_BASE}, {_SOURCES}, rest AS (SELECT f.case_id, f.source_id, f.chunk_id, x.rank AS packet, row_number() OVER (PARTITION BY f.case_id, f.source_id ORDER BY f.rank, f.score DESC, f.chunk_id) AS n FROM fused f JOIN final x ON f.case_id = x.case_id AND f.source_id = x.source_id AND f.chunk_id <> x.chunk_id),
flat AS (SELECT case_id, chunk_id, rank AS packet, 0 AS n FROM final UNION ALL SELECT case_id, chunk_id, packet, n FROM rest WHERE n <= 2)
SELECT case_id, chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY packet, n) - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY case_id, chunk_id ORDER BY packet, n) AS once FROM flat) WHERE once = 1""",
    "metadata_filter": f"WITH {_CORPUS} SELECT chunk_id, source_id FROM meta WHERE law_status = 'effective' AND list_has_any(topic_tags, ['de', 't2']) AND can_cite_clause = false",
    "clause_citable_filter": f"WITH {_CORPUS} SELECT chunk_id, source_id, article_no FROM meta WHERE law_status = 'effective' AND citation_role = 'primary_legal_basis' AND can_cite_clause",
    "citation_roles": """WITH r AS (SELECT source, doc_id, CASE WHEN source IN ('src0', 'src3') THEN 'primary_legal_basis' WHEN source IN ('src1', 'src12') THEN 'conditional_local_basis' WHEN source IN ('src5') THEN 'conditional_industry_basis'
  WHEN source IN ('src7', 'src8') THEN 'implementation_reference' ELSE 'interpretation_auxiliary' END AS citation_role FROM documents)
SELECT citation_role, CASE citation_role WHEN 'primary_legal_basis' THEN 'legal_basis' WHEN 'implementation_reference' THEN 'implementation_reference' WHEN 'interpretation_auxiliary' THEN 'policy_explanation' ELSE 'conditional_basis' END AS usage,
 citation_role = 'primary_legal_basis' AND doc_id % 3 = 0 AS can_cite_clause, count(*) AS n FROM r GROUP BY ALL""",
    "citation_groups": f"""{_BASE}, {_rrf('lists', 20)}, u AS (SELECT case_id, fused.chunk_id, rank, applicable_region, can_cite_clause, CASE citation_role WHEN 'primary_legal_basis' THEN 'legal_basis' WHEN 'implementation_reference' THEN 'implementation_reference' WHEN 'interpretation_auxiliary' THEN 'policy_explanation' ELSE 'conditional_basis' END AS wanted FROM fused JOIN meta USING (chunk_id)),
d AS (SELECT *, CASE WHEN wanted IN ('legal_basis', 'conditional_basis') AND NOT can_cite_clause THEN 'implementation_reference' ELSE wanted END AS usage FROM u),
n AS (SELECT *, CASE WHEN usage = 'conditional_basis' AND applicable_region <> 'CN' THEN '仅适用于地区：' || applicable_region WHEN usage = 'implementation_reference' THEN '参考标准/实施指南，不作为条款级法律依据' WHEN usage = 'policy_explanation' THEN '政策口径补充，不作为条款级法律依据' END AS note FROM d)
SELECT case_id, usage, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids, arg_min(note, rank) AS scope_note, count(*) FILTER (wanted <> usage) AS n_demoted FROM n GROUP BY case_id, usage""",
    "clean_control_and_space": rf"""SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]+\n', E'\n', 'g'), '\n{{3,}}', E'\n\n', 'g'), E' \n\t\r') || E'\n' AS t FROM documents)""",
    "clean_rule_hits": f"WITH {_RULE_HITS} SELECT doc_id, rule, n FROM hits WHERE n > 0 AND rule IS NOT NULL",
    "rule_hit_totals": f"WITH {_RULE_HITS} SELECT rule, CAST(sum(n) AS BIGINT) AS n FROM hits WHERE n > 0 AND rule IS NOT NULL GROUP BY rule",
    "html_text": f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {_HTML} AS t FROM pages)",
    "faq_units": """WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS t FROM conversations),
u AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '问：' || t ELSE t END AS line, role = 'user' AND t <> '' AS asks FROM t WHERE t <> '' OR role = 'user'),
g AS (SELECT *, sum(CAST(asks AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn, line ROWS UNBOUNDED PRECEDING) AS unit_no FROM u)
SELECT conv_id, CAST(unit_no AS BIGINT) AS unit_no, substr(arg_min(line, (turn, line)), 1, 120) AS question, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS n_chars FROM g WHERE unit_no > 0 GROUP BY conv_id, unit_no""",
    "case_metrics": f"{_METRICS} SELECT case_id, recall_at_3, recall_at_5, mrr_at_10, candidate_recall_at_50, distinct_source_recall_at_5, must_have_recall_at_5, optional_coverage_at_5, duplicate_sources_at_10, abstention_correct, bad_categories FROM graded",
    "mode_metrics": f"{_METRICS} SELECT mode, count(*) AS n_cases, count(recall_at_5) AS n_graded, {_MEANS}, round(avg(CAST(abstention_correct AS INTEGER)), 4) AS rate_abstention_correct, round(avg(CASE WHEN bad_categories <> '' THEN 1 ELSE 0 END), 4) AS rate_is_bad FROM graded GROUP BY mode",
    "bad_case_taxonomy": f"{_METRICS} SELECT mode, category, count(*) AS n FROM (SELECT mode, unnest(string_split(bad_categories, ',')) AS category FROM graded WHERE bad_categories <> '') GROUP BY ALL",
    "span_overlap_eval": f"""WITH {_CORPUS}, {_PHRASE}, {_WINDOWS}, own AS (SELECT p.query_id AS case_id, p.chunk_id AS doc_id, instr(c.text, a.text) - 1 AS s, length(a.text) AS n FROM phrase p JOIN corpus c USING (chunk_id) JOIN asked a USING (query_id)),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY doc_id) AS k FROM own WHERE s >= 0) WHERE k = 1),
w AS (SELECT case_id, start, "end", row_number() OVER (PARTITION BY case_id ORDER BY start) AS rank, greatest(0, least("end", s + n) - greatest(start, s)) / CAST(n AS DOUBLE) AS overlap FROM win JOIN g USING (doc_id)),
b AS (SELECT case_id, min(rank) AS doc_rank, min(CASE WHEN overlap > 0 THEN rank END) AS span_rank, round(max(overlap), 6) AS best_overlap FROM w GROUP BY case_id)
SELECT case_id, doc_rank, span_rank, coalesce(best_overlap, 0) AS best_overlap, coalesce(doc_rank <= 5, false) AS doc_hit_at_5, coalesce(span_rank <= 5, false) AS span_hit_at_5 FROM b""",
    "retrieval_cases": f"WITH {_CORPUS} SELECT printf('retrieval_%04d', row_number() OVER (ORDER BY doc_id) - 1) AS case_id, CASE WHEN doc_id % 4 = 0 AND coalesce(label, '') <> '' THEN label || '规定了什么？' WHEN coalesce(article_no, '') <> '' THEN title || article_no || '规定了什么？' ELSE title || '的核心内容是什么？' END AS question, doc_id, chunk_id FROM corpus ORDER BY doc_id LIMIT 60",
    "suite_cap": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5",
    "governance_counts": f"WITH {_CORPUS}, p AS (SELECT 'source_id' AS dimension, coalesce(source_id, 'unknown') AS value FROM meta UNION ALL SELECT 'lang', coalesce(lang, 'unknown') FROM meta UNION ALL SELECT 'citation_role', citation_role FROM meta UNION ALL SELECT 'law_status', law_status FROM meta UNION ALL SELECT 'article_no', coalesce(article_no, 'unknown') FROM meta UNION ALL SELECT 'topic_tags', unnest(topic_tags) FROM meta) SELECT dimension, value, count(*) AS n FROM p GROUP BY ALL",
    "governance_report": f"WITH {_CORPUS}, p AS (SELECT 'lang' AS dimension, coalesce(lang, 'unknown') AS value, count(*) AS n FROM meta GROUP BY ALL UNION ALL SELECT 'law_status', law_status, count(*) FROM meta GROUP BY ALL) SELECT dimension, '- ' || value || ': ' || n AS line, row_number() OVER (PARTITION BY dimension ORDER BY value) AS line_no FROM p",
    "fact_extraction": rf"""WITH {_FACTS} SELECT case_id, array_to_string(list_transform(list_filter(['article', 'pronoun', 'preposition'], lambda x: list_contains(dt, x)), lambda x: x), ',') AS data_types, sensitive_personal_info, cross_border_transfer, overseas_recipient, processing_purpose, consent0 AS legal_basis_or_consent, industry, region,
 concat_ws(',', CASE WHEN cross_border_transfer AND overseas_recipient IS NULL THEN 'overseas_recipient' END, CASE WHEN consent0 IS NULL THEN 'legal_basis_or_consent' END, CASE WHEN cross_border_transfer AND NOT has_volume THEN 'data_volume_threshold' END, CASE WHEN processing_purpose IS NULL THEN 'processing_purpose' END, CASE WHEN len(dt) = 0 THEN 'data_types' END) AS missing_information FROM f1""",
    "evidence_self_check": f"{_CHECK} SELECT case_id, issues, status FROM checked",
    "boost_summary": f"""WITH {_CORPUS}, {_CASE_FACTS}, a AS (SELECT *, case_id % 5 = 0 AS missing FROM cf)
SELECT case_id, 'primary_legal_basis' AS rule, 1.2::DOUBLE AS boost FROM a UNION ALL SELECT case_id, 'interpretation_auxiliary', 0.85::DOUBLE FROM a
UNION ALL SELECT case_id, 'primary_legal_basis:cross_border', 1.25::DOUBLE FROM a WHERE cross_border
UNION ALL SELECT case_id, 'conditional_local_basis:' || code, 1.5::DOUBLE FROM a WHERE region IS NOT NULL UNION ALL SELECT case_id, 'conditional_local_basis:mismatch', 0.45::DOUBLE FROM a WHERE region IS NOT NULL
UNION ALL SELECT case_id, 'conditional_industry_basis:' || industry, 1.4::DOUBLE FROM a WHERE industry IS NOT NULL UNION ALL SELECT case_id, 'conditional_industry_basis:mismatch', 0.75::DOUBLE FROM a WHERE industry IS NOT NULL
UNION ALL SELECT case_id, 'implementation_reference:missing_information', 1.15::DOUBLE FROM a WHERE missing UNION ALL SELECT case_id, 'query_type:missing_information', 0.7::DOUBLE FROM a WHERE missing""",
    "second_queries": f"""{_CHECK}, s AS (SELECT case_id, contains(issues, 'no_primary_legal_basis') OR contains(issues, 'only_auxiliary_evidence') AS basis, contains(issues, 'region_mismatch') AS reg, contains(issues, 'industry_mismatch') AS ind,
  contains(issues, 'cross_border_mismatch') AS border FROM checked WHERE status = 'needs_second_retrieval'),
t AS (SELECT case_id, list_concat(list_concat(list_concat(CASE WHEN basis THEN ['assessment', 'transfer', 'conditions', 'protection'] ELSE [] END, CASE WHEN reg THEN ['lists'] ELSE [] END), CASE WHEN ind THEN ['english rules'] ELSE [] END),
  CASE WHEN border THEN CASE WHEN basis THEN ['abroad'] ELSE ['assessment', 'transfer', 'abroad'] END ELSE [] END) AS texts FROM s),
u AS (SELECT case_id, list_concat(list_transform(texts, lambda x: {{'k': 'legal_issue', 't': x}}), [{{'k': 'material_fact', 't': concat_ws(' ', 'article', industry, region)}}]) AS q FROM t JOIN cf USING (case_id))
SELECT case_id, 'q_' || i AS query_id, q[i].k AS query_type, q[i].t AS text, CAST(20 AS BIGINT) AS top_k FROM (SELECT case_id, q, unnest(range(1, len(q) + 1)) AS i FROM u)""",
    "merged_facts": f"""WITH {_FACTS}, {_FACTS.replace("role = 'user'", "role = 'assistant'").replace('m AS (', 'am AS (', 1).replace('f0 AS (', 'a0 AS (').replace('f1 AS (', 'a1 AS (').replace('FROM m', 'FROM am').replace('FROM f0', 'FROM a0')},
b AS (SELECT u.case_id, u.dt AS udt, coalesce(a.dt, []) AS adt, coalesce(u.overseas_recipient, a.overseas_recipient) AS overseas_recipient, coalesce(u.processing_purpose, a.processing_purpose) AS processing_purpose,
  coalesce(u.industry, a.industry) AS industry, coalesce(u.region, a.region) AS region, coalesce(u.consent0, a.consent0) AS consent, a.case_id AS other,
  [CASE WHEN u.cross_border_transfer AND u.overseas_recipient IS NULL THEN 'overseas_recipient' END, CASE WHEN u.consent0 IS NULL THEN 'legal_basis_or_consent' END, CASE WHEN u.cross_border_transfer AND NOT u.has_volume THEN 'data_volume_threshold' END,
   CASE WHEN u.processing_purpose IS NULL THEN 'processing_purpose' END, CASE WHEN len(u.dt) = 0 THEN 'data_types' END] AS um,
  [CASE WHEN a.cross_border_transfer AND a.overseas_recipient IS NULL THEN 'overseas_recipient' END, CASE WHEN a.case_id IS NOT NULL AND a.consent0 IS NULL THEN 'legal_basis_or_consent' END, CASE WHEN a.cross_border_transfer AND NOT a.has_volume THEN 'data_volume_threshold' END,
   CASE WHEN a.case_id IS NOT NULL AND a.processing_purpose IS NULL THEN 'processing_purpose' END, CASE WHEN len(a.dt) = 0 THEN 'data_types' END] AS am2 FROM f1 u LEFT JOIN a1 a ON u.case_id = a.case_id),
c AS (SELECT *, list_concat(list_filter(['article', 'pronoun', 'preposition'], lambda x: list_contains(udt, x)), list_filter(['article', 'pronoun', 'preposition'], lambda x: list_contains(adt, x) AND NOT list_contains(udt, x))) AS dts,
  ['overseas_recipient', 'legal_basis_or_consent', 'data_volume_threshold', 'processing_purpose', 'data_types'] AS names FROM b),
e AS (SELECT *, [CASE WHEN overseas_recipient IS NOT NULL THEN 'overseas_recipient' END, CASE WHEN processing_purpose IS NOT NULL THEN 'processing_purpose' END, CASE WHEN consent IS NOT NULL THEN 'legal_basis_or_consent' END, CASE WHEN len(dts) > 0 THEN 'data_types' END] AS known FROM c)
SELECT case_id, array_to_string(dts, ',') AS data_types, overseas_recipient, processing_purpose, industry, region,
  array_to_string(list_filter(list_concat(list_filter(names, lambda x: list_contains(um, x)), list_filter(names, lambda x: list_contains(am2, x) AND NOT list_contains(um, x))), lambda x: NOT list_contains(known, x)), ',') AS missing_information FROM e""",
    "review_routing": f"""WITH {_FACTS} SELECT case_id, (CASE WHEN cross_border_transfer IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN sensitive_personal_info IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN industry IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN region IS NOT NULL THEN 1 ELSE 0 END) >= 2
  OR contains(text, 'schst') OR contains(text, 'erheou') AS analyst,
  regexp_matches(lower(text), 'eu ai act|ccpa|cpra|gdpr') OR (len(dt) = 0 AND cross_border_transfer IS NULL AND processing_purpose IS NULL AND industry IS NULL AND region IS NULL) AS judgment FROM f1""",
    "second_pass": f"{_CHECK} SELECT case_id, verdict AS status FROM after",
    "review_results": f"""{_CHECK}, r AS (SELECT case_id, CASE WHEN verdict = 'insufficient' THEN 'insufficient_evidence' WHEN cross_border AND sensitive THEN 'high' WHEN cross_border OR sensitive THEN 'medium' ELSE 'low' END AS risk_level FROM after),
c AS (SELECT *, risk_level = 'insufficient_evidence' AS unclear, case_id % 3 = 0 AS agreed, case_id % 7 = 0 AS twice FROM cf JOIN r USING (case_id)),
n AS (SELECT case_id, count(*) AS n FROM fused GROUP BY case_id)
SELECT case_id, risk_level, md5(CASE WHEN unclear THEN '证据不足，无法做出明确判断。建议补充关键事实信息后重新审查。'
    ELSE (CASE WHEN cross_border THEN '该场景涉及数据出境，' || CASE risk_level WHEN 'high' THEN '存在高风险合规问题，需立即采取整改措施。' WHEN 'medium' THEN '可能需要申报数据出境安全评估。' ELSE '但风险较低。' END
      WHEN sensitive THEN '该场景涉及敏感个人信息处理，需遵守单独同意等特殊保护要求。' ELSE '该场景的合规风险较低。' END) || CASE WHEN critical THEN ' 注意：关键信息缺失（overseas_recipient），影响风险判断的准确性。' ELSE '' END END
    || E'\\n\\n本结论基于当前材料和已召回证据，**不构成正式法律意见**。') AS conclusion,
  concat_ws(',', CASE WHEN cross_border THEN 'cross_border_transfer' END, CASE WHEN sensitive THEN 'sensitive_personal_info' END, CASE WHEN risk_level = 'high' THEN 'high_risk_triggers' END, CASE WHEN critical THEN 'missing_information' END) AS trigger_reasons,
  CASE WHEN unclear THEN concat_ws(',', '补充关键事实信息后重新审查', CASE WHEN critical THEN '明确境外接收方信息' END)
    ELSE concat_ws(',', CASE WHEN cross_border AND risk_level IN ('high', 'medium') THEN '评估是否需要申报数据出境安全评估' END, CASE WHEN cross_border AND NOT agreed THEN '获取用户单独同意并留存告知记录' END,
      CASE WHEN sensitive THEN '对敏感个人信息实施单独同意和加密等保护措施' END, CASE WHEN twice THEN '已触发二次检索补充证据，请关注证据完整性' END) END AS recommended_actions,
  concat_ws(',', CASE WHEN cross_border THEN '本结论基于当前提供的数据出境场景，如出境方式或接收方变更需重新评估' END, CASE WHEN critical THEN '以下信息缺失可能影响判断准确性：overseas_recipient' END,
    CASE WHEN unclear THEN '当前证据不足以做出确定性判断，结论仅供参考' ELSE '本结论基于当前检索到的法律法规和标准，不构成正式法律意见' END) AS risk_boundaries, n AS n_citations
FROM c LEFT JOIN n USING (case_id)""",
    "risk_decision": f"{_CHECK} SELECT case_id, CASE WHEN verdict = 'insufficient' THEN 'insufficient_evidence' WHEN cross_border AND sensitive THEN 'high' WHEN cross_border OR sensitive THEN 'medium' ELSE 'low' END AS risk_level FROM after",
    "claim_grounding": f"""{_BASE}, {_rrf('lists', 10)}, s AS (SELECT query_id AS case_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\\.', '!', 'g'), '[^。！？!?]*[。！？!?]|[^。！？!?]+$'), lambda x: trim(x)), lambda x: x <> '') AS c FROM asked),
ids AS (SELECT case_id, chunk_id, rank FROM fused WHERE rank < 3), ok AS (SELECT i.* FROM ids i JOIN meta USING (chunk_id) WHERE citation_role <> 'interpretation_auxiliary'),
sup AS (SELECT case_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS support FROM ok GROUP BY case_id)
SELECT case_id, unnest(range(len(c))) AS claim_pos, support FROM s JOIN sup USING (case_id)""",
    "dossiers": f"{_ISSUES} SELECT p.case_id, p.issue_id, coalesce(string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank), '') AS chunk_ids, count(DISTINCT source_id) AS n_sources, count(chunk_id) = 0 AS gap FROM plan p LEFT JOIN hits h ON p.case_id = h.case_id AND p.issue_id = h.issue_id GROUP BY ALL",
    "latest_artifact": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "first_seen_dedup": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "upsert_merge": "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE event_type NOT IN ('purchase', 'view') UNION ALL SELECT event_id, user_id, round(value + 1, 6) FROM events WHERE event_type IN ('purchase', 'view')",
    "mock_embeddings": "WITH h AS (SELECT item_id AS query_id, sha256(text) AS s FROM benchmark), b AS (SELECT query_id, i, CAST(('0x' || substr(s, CAST(i * 2 + 1 AS INTEGER), 2)) AS INTEGER)::DOUBLE AS x FROM h, range(8) r(i)), n AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM b GROUP BY query_id) SELECT query_id, i, round(x / n, 6) AS x FROM b JOIN n USING (query_id)",
    "latency_by_stage": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(max(value), 4) AS max_value, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
    "windowed_events": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_events": "SELECT start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events) GROUP BY ALL",
    "session_events": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k",
    "label_agreement": "SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_good, CAST(sum(toxic) AS BIGINT) AS n_toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "json_documents": """WITH n AS (SELECT user_id, event_type, event_id, props, ts, count(*) OVER (PARTITION BY user_id) AS n, min(ts) OVER (PARTITION BY user_id) AS first,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
l AS (SELECT user_id, event_type, event_id, CASE WHEN i = 1 THEN 'events / ' || event_type || chr(10) ELSE '' END || 'events / ' || event_type || ' / event ' || event_id || CASE WHEN trim(props) <> '' THEN chr(10) || trim(props) ELSE '' END AS line, n, first FROM n),
t AS (SELECT user_id, min(n) AS n, 'user ' || user_id || chr(10) || '制定机关：' || chr(10) || '公布日期：' || strftime(min(first), '%Y-%m-%d') || chr(10) || '施行日期：' || chr(10) || '法规类型：' || chr(10) || 'events' || chr(10) ||
 string_agg(line, chr(10) ORDER BY event_type, event_id) AS t FROM l GROUP BY user_id)
SELECT user_id, n % 2 = 0 AS parsed, CASE WHEN n % 2 = 0 THEN len(string_split(t, chr(10))) END AS n_lines, CASE WHEN n % 2 = 0 THEN md5(t) END AS digest FROM t""",
    "file_dispatch": f"""WITH f AS (
 SELECT 'raw/pages-' || page_id || '.html' AS path, 'html_text_parser' AS parser, {_HTML} AS t, NULL AS error, NULL AS hint FROM pages
 UNION ALL SELECT 'raw/documents-' || doc_id || '.txt', 'plain_text_parser', text, CASE WHEN text IS NULL THEN 'no content' END, NULL FROM documents
 UNION ALL SELECT 'raw/events-' || event_id || '.json', 'json_parser', '制定机关：' || chr(10) || '公布日期：' || chr(10) || '施行日期：' || chr(10) || '法规类型：', NULL, NULL FROM events
 UNION ALL SELECT 'raw/benchmark-' || item_id || '.docx', 'docx_parser', NULL, 'DOCX parser received a non-zip document', 'benchmark-' || item_id || '.docx 不是有效的 DOCX 文件（ZIP 头校验失败），可能是旧版 .doc 或损坏文件，请另存为 .docx 后重试。' FROM benchmark
 UNION ALL SELECT 'raw/conversations-' || conv_id || '.pdf', NULL, NULL, 'an external parser is needed for .pdf', '无法解析文件 conversations-' || conv_id || '.pdf：an external parser is needed for .pdf' FROM conversations)
SELECT path, parser, md5(t) AS digest, error, coalesce(hint, CASE WHEN error IS NOT NULL THEN '无法解析文件 ' || split_part(path, '/', 2) || '：' || error END) AS hint FROM f""",
}
