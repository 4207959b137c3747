"""Text functions as column expressions."""

from __future__ import annotations

import json
import unicodedata
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that becomes a space, and the CJK ranges that tokens keep.
CJK_PUNCTUATION = "，。；：、（）《》\"'【】「」　"
CJK = "\\u4e00-\\u9fff\\u3400-\\u4dbf"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ws(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@cache
def _composed() -> tuple[str, str, str]:
    """By rule: a pattern of ASCII letters with marks that NFC makes one letter of, and characters that NFC turns into CJK or ASCII ones, with those."""
    nfc = lambda t: unicodedata.normalize("NFC", t)
    marks = [chr(c) for c in range(0x300, 0x370)]
    letters = []
    for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        own = "".join(m for m in marks if len(nfc(x + m)) == 1)
        if own:
            letters.append(f"{x}\\p{{M}}*?[{own}]\\p{{M}}*")
    single = [chr(c) for c in (0x212A, *range(0xF900, 0xFADA)) if len(nfc(chr(c))) == 1 and nfc(chr(c)) != chr(c)]
    return "|".join(letters), "".join(single), "".join(nfc(c) for c in single)


def composed_tokens(text: Column) -> Column:
    """The text as far as tokens see NFC: letters with marks are no ASCII letters, compatibility characters are the plain ones.

    Texts without any of them, nearly all, are looked through once and stay as they are.
    """
    pattern, single, plain = _composed()
    return F.when(text.rlike(f"[\\u0300-\\u036F{single[0]}\\uF900-\\uFADA]"), F.regexp_replace(F.translate(text, single, plain), pattern, " ")).otherwise(text)


def normalize_text(text: Column) -> Column:
    """All but CJK and ASCII letters and digits, after NFC, as single spaces, trimmed, in lower case."""
    kept = F.regexp_extract_all(composed_tokens(text), F.lit(f"[{CJK}A-Za-z0-9]+"), F.lit(0))  # quicker than replacing what lies between
    return F.lower(F.array_join(kept, " "))


def tokens(text: Column) -> Column:
    """ASCII runs, then the bigrams of all CJK characters in a row and the last of them. One pass over a text without CJK."""
    none = F.array().cast("array<string>")

    def pairs(cjk: Column) -> Column:
        size = F.length(cjk)
        bigrams = F.when(size >= 2, F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(cjk, i, F.lit(2)))).otherwise(none)
        return F.concat(bigrams, F.array(F.substring(cjk, size, F.lit(1))))

    def found(plain: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.lower(t))
        cjk = F.when(plain.rlike(f"[{CJK}]"), let(F.regexp_replace(plain, f"[^{CJK}]+", ""), pairs)).otherwise(none)
        return F.concat(runs, cjk)

    return let(composed_tokens(text), found)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets given as arrays without repeats; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def contains_any(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)), F.lit(False))


def first_label(text: Column, table: dict[str, str]) -> Column:
    """The label of the first term, in table order, that the text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), F.lit(label)) for t, label in table.items()])


def labels_of(text: Column, table: dict[str, str]) -> Column:
    """Distinct labels of all terms contained, in table order."""
    found = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(label).alias("l")) for t, label in table.items()])
    return F.array_distinct(F.transform(F.filter(found, lambda x: F.contains(text, x["t"])), lambda x: x["l"]))


def title_of(text: Column) -> Column:
    """The first line that isn't blank."""
    return F.trim(F.split_part(F.ltrim(text, F.lit(" \n\r\t")), F.lit("\n"), F.lit(1)))


def html_to_text(html: Column) -> Column:
    """Readable text: scripts and styles gone, block ends as line feeds, cells parted by bars, entities undone."""
    steps = [
        (r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(?:p|div|tr|li|h[1-6]|ul|ol|table)\s*>", "\n"),
        (r"(?i)<(?:td|th)[^>]*>", ""),
        (r"(?i)</(?:td|th)\s*>", " | "),
        (r"<[^>]+>", ""),
    ]
    for pattern, by in steps:
        html = F.regexp_replace(html, pattern, by)
    return strip_ws(F.regexp_replace(F.regexp_replace(unescape_html(html), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


@cache
def _entities() -> str:
    """The named entities as JSON."""
    return json.dumps({name[:-1]: by for name, by in html5.items() if name.endswith(";")})


#: Entities that nearly all texts do with; the ampersand is last, so that nothing is undone twice.
_FREQUENT = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\u00a0", "amp": "&"}
_OTHER = _ENTITY.replace("&(?:", "&(?!(?:" + "|".join(_FREQUENT) + ");)(?:", 1)


def unescape_html(text: Column) -> Column:
    """Named and numeric entities (ended by a semicolon) undone; unknown names stay.

    Texts with none but the frequent ones take a few plain replacements, others are taken apart.
    """
    plain = text
    for name, by in _FREQUENT.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(by))
    return F.when(~F.contains(text, F.lit("&")), text).when(text.rlike(_OTHER), _unescaped(text)).otherwise(plain)


def _unescaped(text: Column) -> Column:
    table = F.from_json(F.lit(_entities()), "map<string,string>")

    def undone(entity: Column) -> Column:
        name = F.substring(entity, F.lit(2), F.length(entity) - 2)
        digits = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).otherwise(F.substring(name, F.lit(2), F.length(name)))
        code = digits.cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        return F.when(F.startswith(name, F.lit("#")), char).otherwise(F.coalesce(F.try_element_at(table, name), entity))

    def joined(found: Column) -> Column:
        gaps = F.split(text, _ENTITY, -1)
        return F.array_join(F.flatten(F.zip_with(gaps, F.transform(found, undone), lambda g, e: F.array(g, F.coalesce(e, F.lit(""))))), "")

    return let(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), joined)


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def mock_embedding(text: Column, dim: int) -> Column:
    """The bytes of the text's SHA-256 over and over, of unit length."""
    digest = F.sha2(F.encode(text, "utf-8"), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("double"))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))

    return let(raw, unit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
