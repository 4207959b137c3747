import math
import random
import string
import re

from pyspark.sql import functions as F

from corpusloom.llm import secrets as Z

S = "doc_id long, text string, spans string"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def told(r):
    return sorted(((s.kind, s.start, s.end) for s in [*r.assign, *r.access, *r["hex"]]), key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


TEXTS = [
    "", "password=hunter22 é😀 token: 'abc' token: \"abcdef\"", "secret=token: abcdefgh", "API_KEY = x.y-z=1 apikey:  q", "AKIA" + "A" * 16 + " AKIAB AKIA" + "9" * 30, "f" * 24 + "g" + "0" * 23, "PassWd'=' longer_value==", "passwordpassword=abcdef12",
]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["password", "token", "secret", ":", "=", " ", "'", '"', "abcdef", "AKIA", "0123456789abcdef", "Z9", "é", "\n", "api_key", "x"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], S)
    got = {r.doc_id: told(r) for r in Z.find_secrets(df).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_battery_finds_random_tokens_and_leaves_words(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(30)]
    words = ["donaudampfschifffahrtsgesellschaft", "internationalization_of_things", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "this-is-a-long-hyphenated-heading-of-words", "abababababababababababab"]
    df = spark.createDataFrame([(i, f"see {k} here", "") for i, k in enumerate(keys)] + [(100 + i, f"see {w} here", "") for i, w in enumerate(words * 20)], S)
    rows = {r.doc_id: r.random for r in Z.find_secrets(df).collect()}
    assert sum(bool(rows[i]) for i in range(30)) >= 26
    assert not any(rows[100 + i] for i in range(100))
    assert all((s.start, s.end) == (4, 44) for i in range(30) for s in rows[i])


def told_apart(token):
    """The battery, in plain code: distance from words and p-value of randomness."""
    for pattern, size, mid in (("[0-9]+", 10, 53), ("[0-9a-f]+", 16, 56), ("[0-9A-F]+", 16, 56), ("[A-Z2-7]+=*", 32, 75), ("[A-Za-z0-9]+", 62, 86), (".*", 64, 86)):
        if re.fullmatch(pattern, token):
            break
    codes = [ord(c) for c in token.rstrip("=")]
    n, df = len(codes), size - 1
    chi = sum((codes.count(c) - n / size) ** 2 for c in set(codes)) * size / n + (size - len(set(codes))) * n / size
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = sum(c >= mid for c in codes)
    switches = sum((x >= mid) != (y >= mid) for x, y in zip(codes, codes[1:]))
    expected = 2 * high * (n - high) / n
    z_runs = -9.0 if min(high, n - high) < 2 else (switches - expected) / math.sqrt(max(expected * (expected - 1) / (n - 1), 1e-9))
    mean = sum(codes) / n
    power = sum((c - mean) ** 2 for c in codes)
    z_serial = 9.0 if power == 0 else sum((x - mean) * (y - mean) for x, y in zip(codes, codes[1:])) / power * math.sqrt(n)
    half = 0.0
    for z in (z_chi, z_runs, z_serial):
        a = min(abs(z), 20.0)
        half += math.log(1 + math.exp(0.07056 * a**3 + 1.5976 * a)) - math.log(2)
    shift = n * max(size * Z.WORD_CONCENTRATION - 1, 0.25)
    spread = math.sqrt(2 * (df + 2 * shift))
    usual = (n - 1) * Z.WORD_SWITCHES
    wide = math.sqrt(usual * (1 - Z.WORD_SWITCHES))
    parts = [
        ((chi - df - shift) / spread, shift / spread),
        ((usual - switches) / wide, max(expected - usual, 0.0) / wide),
        ((Z.WORD_SERIAL - z_serial / math.sqrt(n)) * math.sqrt(n) / Z.WORD_SERIAL_SPREAD, -Z.WORD_SERIAL * math.sqrt(n) / Z.WORD_SERIAL_SPREAD),
    ]
    word_z = sum(z * d for z, d in parts) / math.sqrt(sum(d * d for _, d in parts))
    return word_z, math.exp(-half) * (1 + half + half * half / 2)


def score(token):
    word_z, random_p = told_apart(token)
    if random_p < Z.RANDOM:
        return 0
    return min(400, max(0, math.floor(math.log10(1 + math.exp(min(600.0, -(0.07056 * word_z**3 + 1.5976 * word_z)))) * 8)))


def some_tokens(rng, n):
    letters = string.ascii_letters
    words = ["".join(rng.choice("aeiou" if i % 2 else "bcdfglmnprst") for i in range(rng.randint(3, 9))) for _ in range(300)]
    alphabets = [letters + string.digits, letters + string.digits + "+/", string.ascii_uppercase + "234567", "0123456789ABCDEF", string.digits]
    keys = ["".join(rng.choice(rng.choice([alphabets[i % 5]])) for _ in range(rng.randint(20, 70))) for i in range(n)]
    clean = [rng.choice("-_/").join(rng.choice(words) + rng.choice(["", "", str(rng.randint(1, 99))]) for _ in range(rng.randint(4, 9))) for _ in range(n)]
    clean += ["".join(rng.choice(words).capitalize() for _ in range(rng.randint(4, 9))) for _ in range(n)]
    return keys, [c for c in clean if len(c) >= 20]


def test_random_spans_against_plain_code(spark):
    keys, clean = some_tokens(random.Random(11), 120)
    df = spark.createDataFrame([(i, f"see {t} here {t[::-1]}", "") for i, t in enumerate(keys + clean)], S)
    own = [(i, m.start(), m.end(), m[0]) for i, t in enumerate(keys + clean) for m in re.finditer(Z.CANDIDATE, f"see {t} here {t[::-1]}")]
    base = {r.doc_id: told(r) for r in Z.find_secrets(df).collect()}
    own = [(i, s, e, score(t)) for i, s, e, t in own if not any(b < e and s < f for _, b, f in base[i])]
    least = 401
    for level in sorted({x[3] for x in own} - {0}, reverse=True):
        if len(own) * 10 ** (-level / 8) <= Z.LEVEL * sum(x[3] >= level for x in own):
            least = level
    got = {(r.doc_id, s.start, s.end) for r in Z.find_secrets(df).collect() for s in r.random}
    assert got == {x[:3] for x in own if x[3] >= least} and got


def test_realised_rates(spark):
    """Of what is reported nearly all is random; of long random strings of rich alphabets nearly all is reported."""
    keys, clean = some_tokens(random.Random(12), 400)
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(keys + clean)], S)
    got = {r.doc_id for r in Z.find_secrets(df).collect() if r.random}
    wrong = sum(i >= len(keys) for i in got)
    long = [i for i, k in enumerate(keys) if len(k) >= 40 and i % 5 in (0, 1)]
    assert wrong <= 0.01 * len(got) and len(got & set(long)) >= 0.9 * len(long)


def test_many_matches_in_one_text(spark):
    text = "x password=hunter22 é " * 3000
    r = Z.find_secrets(spark.createDataFrame([(1, text, "")], S)).first()
    assert [(s.start, s.end) for s in r.assign] == [m.span() for m in re.finditer("password=hunter22", text)]
    assert Z.redact(spark.createDataFrame([(1, text, "")], S)).first().text == text.replace("password=hunter22", "[SECRET]")


def test_nulls_repeats_empty_and_listing(spark):
    assert Z.find_secrets(spark.createDataFrame([], S)).count() == 0
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "token=abcdefg", "")], S)
    rows = Z.find_secrets(df).select("doc_id", Z.listed(F.concat("assign", "access", "hex")).alias("l")).collect()
    assert sorted((r.doc_id or 0, r.l) for r in rows) == [(0, "assign:0:13"), (1, ""), (1, "")]


def test_redaction_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a password=hunter22 b token=0123456789abcdef0123456789 c", 3), (2, "clean", 5), (3, None, None), (4, "", 0)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in Z.redact(df).collect()}
    assert out[1].text == "a [SECRET] b [SECRET] c" and out[1].n_chars == len(out[1].text)
    assert tuple(out[2]) == (2, "clean", 5) and out[3].text is None and out[4].text == ""


def test_long_text(spark):
    text = ("filler words and more " * 20000) + "password=hunter22"
    r = Z.find_secrets(spark.createDataFrame([(1, text, "")], S)).first()
    assert told(r) == [("assign", len(text) - 17, len(text))]
