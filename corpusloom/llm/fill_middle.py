"""Fill-in-the-middle: documents cut in three at unit bounds, the middle moved to the end.

Texts are worked on as UTF-8 bytes. Cuts by tokens fall on bytes, cuts by characters on code points;
a sparse exception index turns one into the other. It records only the multibyte characters, their
places and the bytes that they and those before them have in excess of one each. A search in it
(``searchsorted``) gives the excess in front of a cut, and over ASCII spans a place is plain arithmetic;
a text of ASCII has an empty index.

Rules: of a document's four hashes the first two choose the cuts, modulo the number of units plus
one, the third whether it is transformed, the fourth the form. ``psm`` is prefix, suffix, middle and
``spm`` suffix, prefix, middle, each part behind its mark. No random state, so reruns agree.

Defined cases: a null text is an empty one; an empty text and one that holds a mark stay plain; a
text of white space is one unit; very long texts are worked on whole; rows of one doc_id are cut
alike as far as their texts are; a null doc_id hashes as the word null; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of output that a task holds before it passes them on.
FLUSH = 1 << 22

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ROW = "doc_id {}, n long, form string, prefix_chars long, middle_chars long, output binary"


class Exceptions(NamedTuple):
    """Multibyte characters of a text: byte places, code-point places, excess bytes up to and with each."""

    at_byte: np.ndarray
    at_char: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        lead = np.flatnonzero(data >= 0xC0)
        own = 1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        excess = np.cumsum(own)
        return cls(lead, lead - (excess - own), excess)

    def _before(self, places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        i = np.searchsorted(places, cuts)  # characters that begin in front of the cut
        return np.where(i > 0, self.excess[i - 1], 0) if len(self.excess) else np.zeros_like(i)

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code-point places of byte places."""
        return cuts - self._before(self.at_byte, cuts)

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Byte places of code-point places."""
        return cuts + self._before(self.at_char, cuts)


def token_ends(data: np.ndarray) -> np.ndarray:
    """Byte places where tokens end: white space with the word behind it, or white space that ends the text."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    space = _SPACE[data]
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(data))


def cut(raw: bytes, digest: str, rate: int, spm: int, unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text; ``digest`` holds the hashes in hex."""
    data = np.frombuffer(raw, dtype=np.uint8)
    index = Exceptions.of(data)
    ends = token_ends(data) if unit == "token" else None
    n = len(ends) if ends is not None else int(index.chars(np.array([len(raw)]))[0])
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not raw or h[2] % 100 >= rate or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    units = np.array(sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if ends is not None:
        at = np.append(0, ends)[units]
        chars = index.chars(at)
    else:
        at, chars = index.bytes(units), units
    a, b = at.tolist()
    p, s, m = PREFIX.encode() + raw[:a], SUFFIX.encode() + raw[b:], MIDDLE.encode() + raw[a:b]
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, int(chars[0]), int(chars[1] - chars[0]), (s + p if form == "spm" else p + s) + m


def fill_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row; ``unit`` is token or char."""
    if unit not in ("token", "char"):
        raise ValueError(f"unknown unit {unit}")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, first = [], 0, 0
            for i in range(batch.num_rows):
                rows.append(cut(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), rate, spm, unit))
                size += len(rows[-1][-1])
                if size > FLUSH or i + 1 == batch.num_rows:
                    own = zip(*rows)
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *[pa.array(c, k) for c, k in zip(own, kinds)]], names)
                    rows, size, first = [], 0, i + 1

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    given = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"), F.substring(hashed, 1, 32).alias("digest"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, _ROW.format(kind)).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    after = lambda at, end: F.substring(output, at + 3, end - at - 3)
    middle = F.substring(output, m + 3, F.length(output))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(after(p, s), middle, after(s, m)))
        .otherwise(F.concat(after(p, m), middle, after(s, p)))
    )
