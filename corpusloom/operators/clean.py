"""Cleaning: ordered rules over texts and lines, each counted.

The rules without order among lines are column expressions. What depends on the lines before
(contents blocks, isolated numbers, letter-spaced runs) is one small function per text in a
pandas UDF.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import rules
from corpusloom.functions.text import strip_ws

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def drop_trailing_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+\n", "\n")


def squeeze_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def simple_clean(text: Column) -> Column:
    """Line ends, control characters, trailing blanks, blank lines; ends in one line feed."""
    t = squeeze_blank_lines(drop_trailing_blanks(drop_controls(unify_newlines(text))))
    return F.concat(F.trim(t, F.lit(" \n\t\r")), F.lit("\n"))


#: How a line that some mechanical rule drops begins, or what it holds: one look at a line instead of one for each rule.
MAY_BE_MECHANICAL = (
    r"(?i)^(?:<!--|\||number of|本文档|[#\[\]()*!_]|\d{4}|technical|cyber|维化|术委|[会委]$|title:|url source|markdown|当前|关闭|中央|中华|承办|技术|京icp|produced|分享|打开|使用|https?:|www\.|tc260|cac\.|flk\.)"
    r"|[.·…．]{4}"
)


def mechanical_rule(line: Column) -> Column:
    """Name of the first rule that drops the (stripped) line, or null."""
    return F.when(line.rlike(MAY_BE_MECHANICAL), _first_rule(line))


def _first_rule(line: Column) -> Column:
    url = F.trim(line, F.lit("[]()")).rlike(rules.SOURCE_URL)
    found = []
    for name, pattern in rules.MECHANICAL.items():
        met = line.rlike(pattern)
        found.append(F.when(met | url if name == "standalone_source_url_lines" else met, F.lit(name)))
    return F.coalesce(*found)


def drop_titles(text: Column, title: Column) -> Column:
    """Struct of the text without the second and later lines equal to the title, and how many went."""
    lines = F.split(text, "\n", -1)
    same = lambda x: F.coalesce((strip_ws(x) == strip_ws(title)) & (title != ""), F.lit(False))
    first = F.array_position(F.transform(lines, same), True)
    kept = F.filter(lines, lambda x, i: ~same(x) | (i + 1 == first))
    return F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("n"))


def drop_lines(text: Column) -> Column:
    """Struct of the text without mechanical lines, and the names of the rules that dropped one, one each."""
    told = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), mechanical_rule(strip_ws(x)).alias("rule")))
    kept = F.array_join(F.transform(F.filter(told, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")
    return F.struct(kept.alias("text"), F.array_compact(F.transform(told, lambda x: x["rule"])).alias("rules"))


def _counted(names: list[str], counts: list[Column]) -> Column:
    """Map of rule and count, zeros left out."""
    every = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*counts))
    return F.map_filter(every, lambda k, n: n > 0)


def _by_rule(rules_met: Column) -> Column:
    """Map of rule and count, of an array that names a rule for each line dropped."""
    return F.map_from_entries(F.transform(F.array_distinct(rules_met), lambda r: F.struct(r, F.size(F.filter(rules_met, lambda x: x == r)))))


def rule_hits(docs: DataFrame) -> DataFrame:
    """doc_id, rule, n: hits of the counted rules in the text as it is, zeros left out. Counts stay in the row: nothing is shuffled."""
    text = unify_newlines(F.col("text"))
    counted = _counted(
        ["control_chars", "trailing_space", "blank_lines"], [F.regexp_count(text, F.lit(CONTROL)), F.regexp_count(text, F.lit(r"[ \t]+\n")), F.regexp_count(text, F.lit(r"\n{3,}"))]
    )
    every = docs.select("doc_id", F.coalesce(counted, F.create_map().cast("map<string,int>")).alias("c"), drop_lines(text)["rules"].alias("r"))
    return every.select("doc_id", F.explode(F.map_concat("c", _by_rule(F.coalesce("r", F.array().cast("array<string>"))))).alias("rule", "n"))


# --- rules that follow the lines one after another -------------------------------------------

_CONTENTS, _CHAPTER, _SPACED, _NUMBER = (re.compile(p) for p in (rules.CONTENTS_TITLE, rules.CHAPTER, rules.SPACED_LETTERS, rules.ISOLATED_NUMBER))
_ENTRY = [re.compile(p) for p in (rules.LEADER_DOTS, rules.PAGE_NUMBER, rules.DIVIDER)]
_BODY = [re.compile(p) for p in (rules.FRONT_MATTER, rules.CHAPTER, rules.FIRST_SECTION, rules.ARTICLE)]


def _filled(lines: list[str], start: int, end: int) -> Iterator[tuple[int, str]]:
    """Places and stripped texts of the lines that aren't blank."""
    return ((i, x) for i, x in ((i, lines[i].strip()) for i in range(start, min(end, len(lines)))) if x)


def _chapters_end(lines: list[str], start: int) -> int | None:
    """Where the first of the chapter headings that follow each other comes again."""
    first = None
    for i, x in _filled(lines, start, len(lines)):
        if x == first:
            return i
        if not _CHAPTER.match(x) or "条" in x:
            return None
        first = first or x
    return None


def _entries_end(lines: list[str], start: int) -> int | None:
    """Where a run of contents entries stops, if it does within the limit."""
    met = False
    for i, x in _filled(lines, start, start - 1 + rules.CONTENTS_LINES):
        body = any(p.match(x) for p in _BODY)
        if not body and any(p.search(x) for p in _ENTRY):
            met = True
        elif met or body:
            return i if met else None
        else:
            return None
    return None


def remove_contents(lines: list[str]) -> tuple[list[str], int]:
    """Without the blocks after contents headings, and how many lines went.

    A block of chapter headings ends where its first heading comes again; a block of dotted
    leaders, page numbers and table dividers where the body starts or another line follows. A
    block without such an end stays.
    """
    out, i = [], 0
    while i < len(lines):
        end = None
        if _CONTENTS.match(re.sub(r"[\s#]+", "", lines[i])):
            end = _chapters_end(lines, i + 1) or _entries_end(lines, i + 1)
        if end is None:
            out.append(lines[i])
        i = i + 1 if end is None else end
    return out, len(lines) - len(out)


def join_spaced_letters(line: str) -> tuple[str, int]:
    """Runs of five or more single letters parted by spaces become words."""
    return _SPACED.subn(lambda m: m[1] + re.sub(r"\s", "", m[2]), line)


def merge_numbers(lines: list[str]) -> tuple[list[str], int]:
    """A bare clause number takes the next line that isn't blank, without heading marks.

    The line right after the number goes, whatever it is: a title beyond blank lines stays as well.
    """
    out, merged, passed = [], 0, -1
    for i, line in enumerate(lines):
        if i == passed:
            continue
        title = next((x for _, x in _filled(lines, i + 1, len(lines))), None) if _NUMBER.match(line.strip()) else None
        if title is None or _NUMBER.match(title):
            out.append(line)
        else:
            out.append(f"{line.strip()} {re.sub(r'^#{1,6}\s+(?=.)', '', title).strip()}")
            merged, passed = merged + 1, i + 1
    return out, merged


def _counts(*names: str) -> T.StructType:
    """A text and its counts."""
    return T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in names]])


#: What a text has to hold for the rules that follow lines to find anything: a contents heading; spaced letters or a line of a number.
HAS_CONTENTS = r"(?i)目[\s#]*[录次]|" + r"[\s#]*".join("contents")
HAS_JOINS = r"[a-zA-Z](?:\s[a-zA-Z]){4}|(?m:^\s*\d+(?:\.\d+){0,4}\s*$)"


@F.pandas_udf(_counts("contents_table_lines"))
def _without_contents(text: pd.Series) -> pd.DataFrame:
    rows = [([], 0) if t is None else remove_contents(t.split("\n")) for t in text]
    return pd.DataFrame({"text": ["\n".join(x) for x, _ in rows], "contents_table_lines": [n for _, n in rows]})


def without_contents(text: Column) -> Column:
    """Struct of a text without contents blocks, and the lines that went; only texts with such a heading leave the JVM."""
    met = text.rlike(HAS_CONTENTS)
    found = _without_contents(F.when(met, text))
    return F.when(met, found).otherwise(F.struct(text.alias("text"), F.lit(0).alias("contents_table_lines")))


def joined_lines(text: Column) -> Column:
    """Struct of a text with spaced letters and isolated numbers joined, and the counts; only texts that hold such leave the JVM."""
    met = text.rlike(HAS_JOINS)
    found = _joined_lines(F.when(met, text))
    return F.when(met, found).otherwise(F.struct(text.alias("text"), F.lit(0).alias("spaced_latin"), F.lit(0).alias("merged_isolated_numbers")))


@F.pandas_udf(_counts("spaced_latin", "merged_isolated_numbers"))
def _joined_lines(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        if t is None:
            rows.append((None, 0, 0))
            continue
        spaced = [join_spaced_letters(x) for x in t.split("\n")]
        merged, n = merge_numbers([x for x, _ in spaced])
        rows.append(("\n".join(merged), sum(k for _, k in spaced), n))
    return pd.DataFrame(rows, columns=["text", "spaced_latin", "merged_isolated_numbers"])


def clean_documents(docs: DataFrame, title: Column) -> DataFrame:
    """docs with cleaned text and ``cleaning_rule_hits`` (rule: count, zeros left out).

    In this order: line ends, control characters, trailing blanks, repeated titles, contents
    blocks, mechanical lines, letter-spaced runs, isolated numbers, blank lines.
    """
    t = unify_newlines(F.coalesce(F.col("text"), F.lit("")))
    own = docs.withColumn("_t", t).withColumn("_p", drop_controls(F.col("_t")))
    own = own.withColumn("_d", drop_titles(drop_trailing_blanks(F.col("_p")), F.coalesce(title, F.lit(""))))
    own = own.withColumn("_c", without_contents(F.col("_d.text"))).withColumn("_m", drop_lines(F.col("_c.text"))).withColumn("_j", joined_lines(F.col("_m.text")))
    own = own.withColumn("_s", strip_ws(F.col("_j.text")))
    counts = {
        "control_chars": F.regexp_count("_t", F.lit(CONTROL)),
        "trailing_space": F.regexp_count("_p", F.lit(r"[ \t]+\n")),
        "duplicate_title": F.col("_d.n"),
        "contents_table_lines": F.col("_c.contents_table_lines"),
        "spaced_latin": F.col("_j.spaced_latin"),
        "merged_isolated_numbers": F.col("_j.merged_isolated_numbers"),
        "blank_lines": F.regexp_count("_s", F.lit(r"\n{3,}")),
    }
    hits = F.map_concat(_counted(list(counts), list(counts.values())), _by_rule(F.col("_m.rules")))
    final = F.concat(squeeze_blank_lines(F.col("_s")), F.lit("\n"))
    return own.withColumn("cleaning_rule_hits", hits).withColumn("text", final).drop("_t", "_p", "_d", "_c", "_m", "_j", "_s")
