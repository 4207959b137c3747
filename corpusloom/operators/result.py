"""Results of a review: templated texts, cleaned reports, citation marks, result rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import let

# The sentences of a result.
DISCLAIMER = "\n\n本结论基于当前材料和已召回证据，**不构成正式法律意见**。"
UNCLEAR = "证据不足，无法做出明确判断。建议补充关键事实信息后重新审查。"
ABROAD, RECIPIENT = "该场景涉及数据出境", "（境外接收方：{}）"
ABROAD_BY_RISK = {"high": "存在高风险合规问题，需立即采取整改措施。", "medium": "可能需要申报数据出境安全评估。"}
ABROAD_ELSE = "但风险较低。"
SENSITIVE = "该场景涉及敏感个人信息处理，需遵守单独同意等特殊保护要求。"
LOW = "该场景的合规风险较低。"
GAPS = " 注意：关键信息缺失（{}），影响风险判断的准确性。"
ACTIONS = {
    "again": "补充关键事实信息后重新审查",
    "legal_basis_or_consent": "确认是否已获得用户单独同意",
    "overseas_recipient": "明确境外接收方信息",
    "data_volume_threshold": "确认处理个人信息的数据量规模",
    "assessment": "评估是否需要申报数据出境安全评估",
    "consent": "获取用户单独同意并留存告知记录",
    "agreement": "与境外接收方（{}）签订数据处理协议",
    "sensitive": "对敏感个人信息实施单独同意和加密等保护措施",
    "second": "已触发二次检索补充证据，请关注证据完整性",
}
BOUNDARIES = {
    "abroad": "本结论基于当前提供的数据出境场景，如出境方式或接收方变更需重新评估",
    "missing": "以下信息缺失可能影响判断准确性：{}",
    "unclear": "当前证据不足以做出确定性判断，结论仅供参考",
    "clear": "本结论基于当前检索到的法律法规和标准，不构成正式法律意见",
}
REFERENCES = "\n\n引用说明：{}\n"
MARKS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
ARTICLE = r"第[一二三四五六七八九十百零〇\d]+条"


def _filled(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


_true = lambda c: F.coalesce(F.col(c), F.lit(False))
_named = lambda c: F.coalesce(F.col(c) != "", F.lit(False))


def conclusion() -> Column:
    """The conclusion of a case row: its facts and risk_level."""
    by_risk = F.coalesce(*[F.when(F.col("risk_level") == r, F.lit(t)) for r, t in ABROAD_BY_RISK.items()], F.lit(ABROAD_ELSE))
    recipient = F.when(_named("overseas_recipient"), _filled(RECIPIENT, F.col("overseas_recipient"))).otherwise("")
    body = F.when(_true("cross_border_transfer"), F.concat(F.lit(ABROAD), recipient, F.lit("，"), by_risk)).when(_true("sensitive_personal_info"), F.lit(SENSITIVE)).otherwise(F.lit(LOW))
    gaps = F.filter("missing_information", lambda m: m.isin(*rules.CRITICAL_FACTS))
    told = F.concat(body, F.when(F.size(gaps) > 0, _filled(GAPS, F.array_join(gaps, "、"))).otherwise(""))
    return F.concat(F.when(F.col("risk_level") == "insufficient_evidence", F.lit(UNCLEAR)).otherwise(told), F.lit(DISCLAIMER))


def trigger_reasons() -> Column:
    return F.array_compact(
        F.array(
            F.when(_true("cross_border_transfer"), F.lit("cross_border_transfer")),
            F.when(_true("sensitive_personal_info"), F.lit("sensitive_personal_info")),
            F.when(_named("overseas_recipient"), F.lit("overseas_recipient_identified")),
            F.when(F.col("risk_level") == "high", F.lit("high_risk_triggers")),
            F.when(F.size("missing_information") > 0, F.lit("missing_information")),
        )
    )


def recommended_actions() -> Column:
    """Actions of a case row; second_pass tells whether a second retrieval has run."""
    asked = F.create_map(*[F.lit(x) for m in rules.CRITICAL_FACTS for x in (m, ACTIONS[m])])
    unclear = F.concat(F.array(F.lit(ACTIONS["again"])), F.array_compact(F.transform("missing_information", lambda m: F.try_element_at(asked, m))))
    abroad = _true("cross_border_transfer")
    clear = F.array_compact(
        F.array(
            F.when(abroad & F.col("risk_level").isin("high", "medium"), F.lit(ACTIONS["assessment"])),
            F.when(abroad & ~_named("legal_basis_or_consent"), F.lit(ACTIONS["consent"])),
            F.when(abroad & _named("overseas_recipient"), _filled(ACTIONS["agreement"], F.col("overseas_recipient"))),
            F.when(_true("sensitive_personal_info"), F.lit(ACTIONS["sensitive"])),
            F.when(_true("second_pass"), F.lit(ACTIONS["second"])),
        )
    )
    return F.when(F.col("risk_level") == "insufficient_evidence", unclear).otherwise(clear)


def risk_boundaries() -> Column:
    return F.array_compact(
        F.array(
            F.when(_true("cross_border_transfer"), F.lit(BOUNDARIES["abroad"])),
            F.when(F.size("missing_information") > 0, _filled(BOUNDARIES["missing"], F.array_join("missing_information", "、"))),
            F.when(F.col("risk_level") == "insufficient_evidence", F.lit(BOUNDARIES["unclear"])).otherwise(F.lit(BOUNDARIES["clear"])),
        )
    )


def review_results(cases: DataFrame, citations: DataFrame, claims: DataFrame) -> DataFrame:
    """One row a case: risk, conclusion, reasons, actions, boundaries, claims and citations.

    cases: the facts, risk_level and second_pass. claims: case_id, claim_pos, claim, support.
    citations: case_id, usage, chunk_id, rank.
    """
    own = cases.select(
        "case_id", "risk_level", conclusion().alias("conclusion"), trigger_reasons().alias("trigger_reasons"), "missing_information",
        recommended_actions().alias("recommended_actions"), risk_boundaries().alias("risk_boundaries"),
    )
    said = claims.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("claim_pos", "claim", "support"))).alias("claims"))
    cited = citations.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("usage", "rank", "chunk_id"))).alias("citations"))
    return own.join(said, "case_id", "left").join(cited, "case_id", "left")


def sanitized(text: Column) -> Column:
    """Markdown without code fences, with headings of level 3 at most, paired bold marks and no bold of more than 50 characters."""

    def paired(t: Column) -> Column:
        parts = F.split(t, r"\*\*", -1)
        # an odd number of marks: the last one goes
        head = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "**")
        return F.when(F.size(parts) % 2 == 0, F.concat(head, F.try_element_at(parts, F.lit(-1)))).otherwise(t)

    plain = F.regexp_replace(F.regexp_replace(text, r"```[^\n]*\n?", ""), r"(?m)^#{1,2}(?!#)\s", "### ")
    return F.regexp_replace(let(plain, paired), r"\*\*([^*\n]{51,120}?)\*\*", "$1")


def cite_phrase(claim: Column) -> Column:
    """The most exact name of an article in a claim: with its law, else alone."""
    full, bare = F.regexp_extract(claim, rf"《[^》]+》\s*{ARTICLE}", 0), F.regexp_extract(claim, ARTICLE, 0)
    return F.coalesce(F.nullif(full, F.lit("")), F.nullif(bare, F.lit("")))


def _places(phrase: str) -> list[re.Pattern]:
    """Where a phrase may stand in a report, the most exact first: book marks and bold are allowed for."""
    article = re.search(ARTICLE, phrase)
    if not article:
        return [re.compile(re.escape(phrase))]
    law, number = phrase[: article.start()].strip().strip("《》").strip(), re.escape(article[0])
    alone = re.compile(number + r"\**")
    return [re.compile(rf"《?{re.escape(law)}》?\s*\**\s*{number}\**"), alone] if law else [alone]


def with_marks(report: str, phrases: list[str | None]) -> str:
    """The report with a numbered mark after the first free place of each phrase; marks without a place are listed at its end."""
    if not report or not phrases:
        return report
    taken, left = set(), []
    for i, (mark, phrase) in enumerate(zip(MARKS, phrases, strict=False)):
        sign = f'<sup class="cite-marker" id="cite-marker-{i}" data-claim-index="{i}">{mark}</sup>'
        ends = (m.end() for p in (_places(phrase) if phrase else ()) for m in p.finditer(report))
        ends = (e + len(report[e:]) - len(report[e:].lstrip("*")) for e in ends)
        at = next((e for e in ends if e not in taken), None)
        if at is None:
            left.append(mark)
            continue
        report = report[:at] + sign + report[at:]
        taken.add(at)
    return report.rstrip() + REFERENCES.format(" ".join(left)) if left else report


def marked_reports(reports: DataFrame, claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """case_id, report with citation marks. claims: case_id, claim_pos, claim, support; chunks: chunk_id, citation_label, article_no."""
    first = claims.select("case_id", "claim_pos", "claim", F.try_element_at("support", F.lit(1)).alias("chunk_id"))
    named = first.join(chunks.select("chunk_id", "citation_label", "article_no"), "chunk_id", "left")
    phrase = F.coalesce(F.nullif("citation_label", F.lit("")), F.nullif("article_no", F.lit("")), cite_phrase(F.col("claim")))
    listed = named.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("claim_pos", phrase.alias("phrase")))).alias("p"))
    own = reports.join(listed, "case_id", "left").select("case_id", "report", F.coalesce(F.col("p.phrase"), F.array().cast("array<string>")).alias("phrases"))

    def mark(batches):
        for b in batches:
            yield pd.DataFrame({"case_id": b["case_id"], "report": [with_marks(r, list(p)) for r, p in zip(b["report"], b["phrases"], strict=True)]})

    return own.mapInPandas(mark, own.select("case_id", "report").schema)
