"""Splitting oversized items at natural boundaries.

Every text has a sorted array of boundary offsets for each kind of boundary (paragraph, line, sentence, word). A piece
ends at the last boundary under the limit, found by binary search in the arrays from the strongest kind to the weakest;
without one it is cut hard, though never within a character that is written with several code points. The next piece
starts at the first boundary among the last `overlap` units of the piece before.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.runtime import small_enough

#: Kinds of boundary, strongest first. A boundary is the end of a match: what separates two pieces stays with the first.
KINDS = (
    regex.compile(r"\n[^\S\n]*\n\s*"),
    regex.compile(r"(?:\r\n|[\n\r\u2028\u2029\u0085])[^\S\n\r]*"),
    regex.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？．][」』”’）]*\s*"),
    regex.compile(r"\s+|[、，；：]"),
)
#: A boundary of a strong kind is taken if the piece has more than this share of the limit; the weakest kind always.
FILL = 0.5
_JOINED = {0x200D, 0xFE0E, 0xFE0F}


@dataclass(frozen=True)
class Limit:
    field_name: str
    max_size: int
    overlap: int

    def __post_init__(self):
        if not 0 <= self.overlap < self.max_size:
            raise ValueError(f"{self.field_name}: the overlap must be less than the size")


def boundaries(text: str) -> list[np.ndarray]:
    """For each kind, the sorted offsets of boundaries of that kind or a stronger one."""
    out, known = [], np.empty(0, np.int64)
    for kind in KINDS:
        found = np.fromiter((m.end() for m in kind.finditer(text)), np.int64)
        known = np.union1d(known, found[found < len(text)])
        out.append(known)
    return out


def _within(text: str, at: int) -> bool:
    """Whether `at` is within what is written with several code points: a base and its accents, a joined sequence, a line end."""
    return bool(unicodedata.combining(text[at])) or ord(text[at]) in _JOINED or ord(text[at - 1]) == 0x200D or text[at - 1 : at + 1] == "\r\n"


def _whole(text: str, at: int, low: int) -> int:
    """The last place at or before `at`, above low, that is not within a character; `at` if one character fills it all."""
    k = at
    while low < k < len(text) and _within(text, k):
        k -= 1
    return k if k > low else at


def _forward(text: str, at: int, high: int) -> int:
    """The first place from `at` on, below high, that is not within a character; `at` if there is none."""
    k = at
    while 0 < k < high and _within(text, k):
        k += 1
    return k if k < high else at


def spans(text: str, limit: int, overlap: int, sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The pieces' offsets: each at most `limit` long, together the whole text, each starting within the last `overlap` of the one before.

    Lengths are in code points; with sizes, the size of each code point in another unit (such as the tokens that end
    with it), they are in that unit, and a code point larger than the limit is a piece of its own.
    """
    n = len(text)
    sums = np.arange(n + 1) if sizes is None else np.concatenate(([0], np.cumsum(sizes)))
    if sums[n] <= limit:
        return [(0, n)]
    kinds, out, start = boundaries(text), [], 0
    while sums[n] - sums[start] > limit:
        most = max(start + 1, int(np.searchsorted(sums, sums[start] + limit, "right")) - 1)
        filled = int(np.searchsorted(sums, sums[start] + max(overlap, limit * FILL), "left"))
        past_overlap = max(start, int(np.searchsorted(sums, sums[start] + overlap, "right")) - 1)
        end = 0
        for k, at in enumerate(kinds):
            i = int(np.searchsorted(at, most, "right")) - 1
            if i >= 0 and at[i] > (filled if k < len(kinds) - 1 else past_overlap):
                end = int(at[i])
                break
        if not end:
            end = max(start + 1, _whole(text, most, past_overlap))
        out.append((start, end))
        if end == n:
            return out
        # A start within the overlap; without a boundary there, as far back as the overlap allows.
        back = max(start + 1, int(np.searchsorted(sums, sums[end] - overlap, "left")))
        weakest = kinds[-1]
        i = int(np.searchsorted(weakest, back, "left"))
        start = int(weakest[i]) if i < len(weakest) and weakest[i] < end else min(end, max(start + 1, _forward(text, back, end)))
    out.append((start, n))
    return out


def limits(sizes: DataFrame, unit: str = "chars") -> list[Limit]:
    """The limits of one unit from a table (field_name, unit, max_size, overlap)."""
    rows = sizes.filter(F.col("unit") == unit)
    if not small_enough(rows, 1000):
        raise ValueError("more than 1000 limits")
    return [Limit(r.field_name, r.max_size, r.overlap or 0) for r in rows.collect()]


def split_oversized(df: DataFrame, key_col: str, bounds: list[Limit]) -> DataFrame:
    """The pieces of every field above its limit: key_col, field_name, piece_no, start_pos, end_pos, piece.

    Sizes are code points. piece_no counts from 0; start_pos and end_pos are offsets in the field, so that cutting the
    field at them gives the piece. Null, empty and small fields have no rows. Repeated keys each give their pieces.
    Columns other than the key and the fields of `bounds` are ignored.
    """
    by_name = {b.field_name: (b.max_size, b.overlap) for b in bounds}
    cells = F.array(*[F.struct(F.lit(b.field_name).alias("field_name"), F.when(F.length(f"`{b.field_name}`") > b.max_size, F.col(f"`{b.field_name}`")).alias("text")) for b in bounds])
    large = df.select(F.col(f"`{key_col}`"), F.inline(cells)).filter(F.col("text").isNotNull())
    key_type = df.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fields, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                rows, numbers, begins, ends, pieces = [], [], [], [], []
                for i, (field, text) in enumerate(zip(fields, texts)):
                    for k, (a, b) in enumerate(spans(text, *by_name[field])):
                        rows.append(i)
                        numbers.append(k)
                        begins.append(a)
                        ends.append(b)
                        pieces.append(text[a:b])
                if rows:
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(pieces, pa.string())],
                        [key_col, "field_name", "piece_no", "start_pos", "end_pos", "piece"],
                    )

    return large.mapInArrow(run, f"`{key_col}` {key_type}, field_name string, piece_no int, start_pos bigint, end_pos bigint, piece string")
