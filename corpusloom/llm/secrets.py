"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Base spans come from three patterns (assignments, access keys, long hexadecimal runs). The
battery adds spans: every other run of 20 or more key characters is a candidate. Its encoding is
inferred (decimal, hexadecimal, base 32, alphanumeric, base 64) and three tests are taken on it:

* chi-squared uniformity of the symbols over the encoding's alphabet (Wilson-Hilferty);
* Wald-Wolfowitz runs above and below the middle of the alphabet;
* lag-1 serial correlation of the symbol ranks.

The three are combined twice. As tests of randomness, by Fisher's method: a candidate whose combined
p-value is under ``RANDOM`` is not random and is left alone. And against the contrary hypothesis,
"symbols as in ordinary words": under it chi-squared is non-central with a shift that grows with the
length, runs are rare and neighbours are correlated, so each test has a distance from words in
standard deviations. These are summed with weights in proportion to how far a random string of this
length and encoding would be, the most powerful weights for independent normal distances; so long
candidates gain evidence and short ones don't. Benjamini-Hochberg over the p-values of all
candidates of the corpus, by a histogram (401 numbers), gives the level up to which they are reported.

Defined cases: null text is empty; repeated rows are scanned each; positions are code points,
end exclusive; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import materialize

#: The base patterns.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
RANDOM = 0.001
LEVEL = 0.001
#: Noise of words, as one over the number of equally likely symbols: the sum of squared letter shares of prose and of names put together from it.
WORD_CONCENTRATION = 0.06
#: Share of neighbours in words on different sides of the alphabet's middle.
WORD_SWITCHES = 0.25
#: Correlation of neighbours in words, and its standard deviation times the root of the length.
WORD_SERIAL, WORD_SERIAL_SPREAD = -0.12, 0.9
#: Matches whose places are summed in one go; sums of sums follow.
RUN = 512

SPAN = "struct<kind:string,start:int,end:int>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end) of leftmost non-overlapping matches: gaps and matches alternate, so lengths add up."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))

    place = "struct<start:int,end:int>"

    def block(pairs: Column) -> Column:
        """Total length of a run of gaps and matches, and the places of the matches from its beginning."""
        return F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{place}>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + x["h"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["h"]).alias("end")))).alias("out"),
            ),
        )

    def shifted(blocks: Column) -> Column:
        begins = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )["out"]
        moved = F.zip_with(blocks, begins, lambda x, at: F.transform(x["out"], lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"))))
        return F.flatten(moved)

    def sums(hs: Column, gs: Column) -> Column:
        pairs = F.zip_with(F.slice(gs, F.lit(1), F.size(hs)), hs, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
        runs = F.sequence(F.lit(0), F.floor(F.size(hs) / RUN).cast("int"))
        return _let(pairs, lambda ps: _let(F.transform(runs, lambda i: block(F.slice(ps, i * RUN + 1, F.lit(RUN)))), shifted))

    return _let(hits, lambda hs: _let(gaps, lambda gs: sums(hs, gs)))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (kind, start, end) by kind."""
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.zip_with(match_spans(text, ASSIGN), value, lambda s, v: F.struct(s.alias("s"), (F.length(v) >= 6).alias("ok")))
    assign = F.transform(F.filter(assign, lambda x: x["ok"]), lambda x: x["s"])
    return {
        "assign": F.when(text.rlike(ASSIGN), _named("assign", assign)).otherwise(_none()),
        "access": F.when(F.contains(text, F.lit("AKIA")), _named("access", match_spans(text, ACCESS))).otherwise(_none()),
        "hex": F.when(text.rlike(HEX), _named("hex", match_spans(text, HEX))).otherwise(_none()),
    }


def _surprise(z: Column) -> Column:
    """-log of the two-sided p-value of a normal (its logistic form)."""
    size = F.least(F.abs(z), F.lit(20.0))
    return F.log(1 + F.exp(0.07056 * F.pow(size, F.lit(3.0)) + 1.5976 * size)) - F.log(F.lit(2.0))


def battery(token: Column) -> Column:
    """Struct: z_chi, z_runs, z_serial (under randomness), random_p (the three combined) and word_z (under ordinary words; low: unlike words)."""
    alphabet = (
        F.when(token.rlike("^[0-9]+$"), F.struct(F.lit(10.0).alias("n"), F.lit(53).alias("mid")))
        .when(token.rlike("^[0-9a-f]+$"), F.struct(F.lit(16.0).alias("n"), F.lit(56).alias("mid")))
        .when(token.rlike("^[0-9A-F]+$"), F.struct(F.lit(16.0).alias("n"), F.lit(56).alias("mid")))
        .when(token.rlike("^[A-Z2-7]+=*$"), F.struct(F.lit(32.0).alias("n"), F.lit(75).alias("mid")))
        .when(token.rlike("^[A-Za-z0-9]+$"), F.struct(F.lit(62.0).alias("n"), F.lit(86).alias("mid")))
        .otherwise(F.struct(F.lit(64.0).alias("n"), F.lit(86).alias("mid")))
    )
    codes = F.transform(F.filter(F.split(F.rtrim(token, F.lit("=")), "", -1), lambda c: c != ""), lambda c: F.ascii(c))

    def tests(cs: Column, a: Column) -> Column:
        n = F.greatest(F.size(cs), F.lit(1)).cast("double")
        squares = F.aggregate(F.array_distinct(cs), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(cs, lambda x: x == c)).cast("double"), F.lit(2.0)))
        chi = squares * a["n"] / n - n
        df = a["n"] - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        high = F.size(F.filter(cs, lambda c: c >= a["mid"])).cast("double")
        low = n - high
        switches = F.size(F.filter(cs, lambda c, i: (i > 0) & ((c >= a["mid"]) != (F.get(cs, i - 1) >= a["mid"])))).cast("double")
        expected = 2 * high * low / n
        spread = F.sqrt(F.greatest(expected * (expected - 1) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
        z_runs = F.when((high < 2) | (low < 2), F.lit(-9.0)).otherwise((switches - expected) / spread)
        mean = F.aggregate(cs, F.lit(0.0), lambda s, c: s + c) / n
        power = F.aggregate(cs, F.lit(0.0), lambda s, c: s + (c - mean) * (c - mean))
        lagged = F.aggregate(F.zip_with(F.slice(cs, F.lit(1), F.greatest(F.size(cs) - 1, F.lit(0))), F.slice(cs, F.lit(2), F.size(cs)), lambda x, y: F.when(y.isNull(), F.lit(0.0)).otherwise((x - mean) * (y - mean))), F.lit(0.0), lambda s, x: s + x)
        z_serial = F.when(power <= 0, F.lit(9.0)).otherwise(lagged / F.greatest(power, F.lit(1e-9)) * F.sqrt(n))
        shift = n * F.greatest(a["n"] * WORD_CONCENTRATION - 1, F.lit(0.25))
        switch = (n - 1) * WORD_SWITCHES
        # distances from words, and where a random string would be
        apart = [
            ((chi - (df + shift)) / F.sqrt(2 * (df + 2 * shift)), shift / F.sqrt(2 * (df + 2 * shift))),
            ((switch - switches) / F.sqrt(switch * (1 - WORD_SWITCHES)), F.greatest(expected - switch, F.lit(0.0)) / F.sqrt(switch * (1 - WORD_SWITCHES))),
            ((WORD_SERIAL - z_serial / F.sqrt(n)) * F.sqrt(n) / WORD_SERIAL_SPREAD, -WORD_SERIAL * F.sqrt(n) / WORD_SERIAL_SPREAD),
        ]
        weight = F.sqrt(sum((d * d for _, d in apart), F.lit(0.0)))
        word_z = sum((z * d for z, d in apart), F.lit(0.0)) / F.greatest(weight, F.lit(1e-9))
        half = sum((_surprise(z) for z in (z_chi, z_runs, z_serial)), F.lit(0.0))
        random_p = F.exp(-half) * (1 + half + half * half / 2)  # chi-squared of 6 degrees of freedom
        return F.struct(z_chi.alias("z_chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"), random_p.alias("random_p"), word_z.alias("word_z"))

    return _let(codes, lambda cs: _let(alphabet, lambda a: tests(cs, a)))


def evidence(word_z: Column) -> Column:
    """-log10 of the p-value, in eighths, 0 to 400 (a logistic form of the normal tail)."""
    minus_log = F.log(1 + F.exp(F.least(F.lit(600.0), -(0.07056 * F.pow(word_z, F.lit(3.0)) + 1.5976 * word_z)))) / F.log(F.lit(10.0))
    return F.least(F.lit(400), F.greatest(F.lit(0), F.floor(minus_log * 8))).cast("int")


def scan_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row of docs (doc_id, text): arrays assign, access, hex, and candidates (start, end, score), and columns kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)
    found = docs.select("doc_id", *keep, text.alias("text"), *[c.alias(k) for k, c in base.items()])
    tokens = F.zip_with(
        match_spans(F.col("text"), CANDIDATE),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)),
        lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(v).alias("t")),
    )
    all_base = F.concat("assign", "access", "hex")
    clear = F.filter(tokens, lambda c: ~F.exists(all_base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    scored = F.transform(clear, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.when(c["t"]["random_p"] >= RANDOM, evidence(c["t"]["word_z"])).otherwise(F.lit(0)).alias("score")))
    none = F.array().cast("array<struct<start:int,end:int,score:int>>")
    return found.select("doc_id", *keep, "assign", "access", "hex", F.when(F.col("text").rlike(CANDIDATE), scored).otherwise(none).alias("candidates"))


def discovery_level(scanned: DataFrame, level: float = LEVEL) -> int:
    """The least score reported: Benjamini-Hochberg over the histogram of all candidates' scores."""
    counts = scanned.select(F.explode("candidates.score").alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in counts)
    above, least = 0, 401
    for r in sorted(counts, key=lambda r: -r["s"]):
        above += r["n"]
        if r["s"] > 0 and total * 10 ** (-r["s"] / 8) <= level * above:
            least = r["s"]
    return least


def find_secrets(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, assign, access, hex, random: arrays of (kind, start, end), for every row of docs."""
    scanned = materialize(scan_texts(docs), "secret-spans")
    least = discovery_level(scanned, level)
    return scanned.select(
        "doc_id",
        "assign",
        "access",
        "hex",
        _named("random", F.filter("candidates", lambda c: c["score"] >= least)).alias("random"),
    )


def listed(spans: Column, kinds: tuple[str, ...] = ("assign", "access", "hex", "random")) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), F.try_element_at(place, s["kind"]).alias("k"), s["end"].alias("e"), s["kind"].alias("n"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["n"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", level: float = LEVEL) -> DataFrame:
    """docs with every span replaced by ``mark``; all rows and columns stay, n_chars follows the text.

    The level is found in a first pass over all texts; a second pass marks, so that no text is shuffled.
    """
    least = discovery_level(materialize(scan_texts(docs).select("candidates"), "secret-scores"), level)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    scanned = scan_texts(rows, "_row")
    spans = F.concat("assign", "access", "hex", _named("random", F.filter("candidates", lambda c: c["score"] >= least)))
    text = F.col("_row.text")

    def cut(ss: Column) -> Column:
        folded = F.aggregate(
            F.sort_array(F.transform(ss, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e")))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["e"]).alias("at"),
                F.when(s["s"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["s"] - acc["at"]), F.lit(mark)))).otherwise(acc["out"]).alias("out"),
            ),
        )
        return _let(folded, lambda f: F.concat(F.array_join(f["out"], ""), F.substring(text, f["at"] + 1, F.length(text))))

    marked = F.when(F.size(spans) == 0, text).otherwise(cut(spans))
    fields = []
    for f in docs.schema.fields:
        if f.name == "text":
            fields.append(marked.alias("text"))
        elif f.name == "n_chars":
            fields.append(F.when(F.size(spans) == 0, F.col("_row.n_chars")).otherwise(F.length(marked)).cast(f.dataType).alias("n_chars"))
        else:
            fields.append(F.col("_row").getField(f.name).alias(f.name))
    return scanned.select(*fields)
