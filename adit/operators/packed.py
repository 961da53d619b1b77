"""Several values packed in one field: split them into one row per value, with position.

The scan works on the Arrow buffers of a whole batch at once. Every byte gets flags (escaped, quoted, protected,
separator) from vectorised passes; runs of other bytes are the values, whose offsets become list arrays that are
flattened with the ordinals of their rows. No cell is looked at by Python code of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.runtime import BROADCAST_ROWS, small_enough

#: Separators of one byte, of several bytes, list marks and blanks.
SEPARATORS = b",;|/\t\n\r"
WIDE_SEPARATORS = tuple("\uff0c\u3001\uff1b\uff5c\u2022\u2023\u25aa\u25cf")
BRACKETS = b"[]{}"
WIDE_BLANKS = ("\u00a0", "\u1680", "\u202f", "\u205f", "\u3000", "\ufeff", "\u2060", "\u0085", *(chr(c) for c in range(0x2000, 0x200C)))
JOINERS = (b"and", b"&")
ABSENT = ("*", "-")
#: Separators that a listed name may hold; names without any need no protection.
HOLDS = r"(?i)[,;|/\t\n\uff0c\u3001\uff1b\uff5c\u2022\[\]{}&'\"]|\band\b"
#: All blanks that Java's trim doesn't know, for the filter that runs before the scan.
BLANK_CLASS = r"[\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u2060\u3000\ufeff\u0085]"


def holds_value(cell: Column) -> Column:
    """False for null, blank, '*' and '-': cells without values."""
    bare = F.regexp_replace(cell, f"^{BLANK_CLASS}+|{BLANK_CLASS}+$", "")
    return cell.isNotNull() & ~bare.isin("", *ABSENT)


def _find(data: np.ndarray, what: bytes) -> np.ndarray:
    """Positions of `what` in data."""
    if len(what) > len(data):
        return np.empty(0, np.int64)
    at = np.flatnonzero(data[: len(data) - len(what) + 1] == what[0])
    for k in range(1, len(what)):
        at = at[data[at + k] == what[k]]
    return at


def _spread(mask: np.ndarray, at: np.ndarray, n: int) -> None:
    for k in range(n):
        mask[at + k] = True


def _neighbours(solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, the last solid one before it (else -1) and the next one behind it (else the number of bytes)."""
    n, index = len(solid), np.arange(len(solid))
    before, behind = np.full(n, -1), np.full(n, n)
    before[1:] = np.maximum.accumulate(np.where(solid, index, -1))[:-1]
    behind[:-1] = np.minimum.accumulate(np.where(solid, index, n)[::-1])[::-1][1:]
    return before, behind


def _quotes(marks: np.ndarray, opens: np.ndarray, closes: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The quotes that open or close a quoted value, and the bytes between them.

    A quote can open where a value begins and close where one ends; any other is an ordinary character, and so is one
    that opens but is never closed. Of neighbouring quotes, an even number stands for characters; of an odd number one
    opens (the first) or closes (the last). Whether a value is open is the parity of what has opened and closed so far.
    """
    n = len(marks)
    outer, inside = np.zeros(n, bool), np.zeros(n, bool)
    at = np.flatnonzero(marks)
    if not len(at):
        return outer, inside
    new = np.concatenate(([True], (np.diff(at) > 1) | (cell[at[1:]] != cell[at[:-1]])))
    start = at[new]
    end = at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))]
    begins, ends = opens[start], closes[end]
    use = ((end - start) % 2 == 0) & (begins | ends)
    start, end, begins, ends = start[use], end[use], begins[use], ends[use]
    if not len(start):
        return outer, inside
    where, index = cell[start], np.arange(len(start))
    head = np.maximum.accumulate(np.where(np.concatenate(([True], where[1:] != where[:-1])), index, 0))
    # A quote that could do both turns the state; one that can do one thing sets it.
    both = begins & ends
    turns = np.cumsum(both)
    setter = np.maximum.accumulate(np.where(~both, index, -1))
    told = setter >= head
    turned = turns - np.where(told, turns[np.maximum(setter, 0)], turns[head] - both[head])
    after = (np.where(told, begins[np.maximum(setter, 0)], False) + turned) % 2 == 1
    before = np.concatenate(([False], after[:-1])) & (index > head)
    step = np.flatnonzero(before != after)
    # Steps open and close in turn; a last one that opens stays alone.
    alone = after[step] & np.concatenate((where[step][1:] != where[step][:-1], [True]))[: len(step)]
    step = step[~alone]
    opened, closed = start[step[after[step]]], end[step[~after[step]]]
    outer[opened] = outer[closed] = True
    level = np.zeros(n + 1, np.int64)
    level[opened] += 1
    level[closed] -= 1
    return outer, np.cumsum(level[:-1]) > 0


_BASE = 1_000_003
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))


def _guarded(lower: np.ndarray, edge: np.ndarray, quoted: np.ndarray, first: np.ndarray, last: np.ndarray, names: list[bytes]) -> np.ndarray:
    """The bytes of listed names that stand between edges, outside quotes, the longer of overlapping ones.

    Names are looked up by a rolling hash of the bytes from every edge, once for each length that names have, whatever
    their number; what is found is compared byte by byte.
    """
    n = len(lower)
    guard = np.zeros(n, bool)
    index = np.arange(n)
    starts = np.flatnonzero(((index == first) | edge[np.maximum(index - 1, 0)]) & ~quoted)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n])))
    inverse = _powers(_UNBASE, n)
    by_length: dict[int, list[bytes]] = {}
    for name in set(names):
        by_length.setdefault(len(name), []).append(name)
    for size in sorted(by_length, reverse=True):
        at = starts[starts + size <= n]
        at = at[(at + size - 1 <= last[at])]
        at = at[(at + size - 1 == last[at]) | edge[np.minimum(at + size, n - 1)]]
        at = at[~guard[at] & ~guard[at + size - 1]]
        if not len(at):
            continue
        text = np.frombuffer(b"".join(sorted(by_length[size])), np.uint8).reshape(-1, size)
        weights = _powers(_BASE, size)[:size]
        wanted = ((text.astype(np.uint64) + np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64)
        order = np.argsort(wanted, kind="stable")
        given = (sums[at + size] - sums[at]) * inverse[at]
        place = np.minimum(np.searchsorted(wanted[order], given), len(order) - 1)
        hit = wanted[order][place] == given
        at, which = at[hit], order[place[hit]]
        same = (lower[at[:, None] + np.arange(size)] == text[which]).all(axis=1)
        at = at[same]
        if len(at) > 1 and (np.diff(at) < size).any():  # the first of overlapping names of one length
            kept, end = [], -1
            for x in at:
                if x >= end:
                    kept.append(x)
                    end = x + size
            at = np.array(kept)
        for k in range(size):
            guard[at + k] = True
    return guard


def split_buffer(data: np.ndarray, offsets: np.ndarray, protected: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Split the cells data[offsets[i]:offsets[i + 1]].

    protected: listed names in UTF-8, their ASCII letters in lower case, that must not be cut.
    Returns the bytes of all values, their offsets, the number of the cell of each value and its position there, from 1.
    """
    n, cells = len(data), len(offsets) - 1
    none = (np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))
    if not n:
        return none
    lengths = np.diff(offsets)
    cell = np.repeat(np.arange(cells), lengths)
    first, last = offsets[:-1][cell], offsets[1:][cell] - 1
    index = np.arange(n)

    # A byte is escaped behind an odd run of backslashes of its cell.
    slash = data == 92
    plain = np.where(slash, -1, index)
    behind = np.empty(n, np.int64)
    behind[0] = -1
    np.maximum.accumulate(plain[:-1], out=behind[1:])
    escaped = (index - 1 - np.maximum(behind, first - 1)) % 2 == 1

    blank = (data == 32) | ((data >= 9) & (data <= 13))
    for ch in WIDE_BLANKS:
        _spread(blank, _find(data, b := ch.encode()), len(b))
    loose = np.isin(data, np.frombuffer(SEPARATORS + BRACKETS, np.uint8)) & ~escaped
    for ch in WIDE_SEPARATORS:
        _spread(loose, _find(data, b := ch.encode()), len(b))
    # Neighbours that are no blank, within the cell; where a value can begin and end, separators that are blanks count.
    prev, after = _neighbours(~blank)
    before, behind = _neighbours(~blank | loose)
    opens = (before < first) | loose[np.maximum(before, 0)]
    closes = (behind > last) | loose[np.minimum(behind, n - 1)]

    double_marks, in_double = _quotes((data == 34) & ~escaped, opens, closes, cell)
    single_marks, in_single = _quotes((data == 39) & ~escaped & ~in_double & ~double_marks, opens, closes, cell)
    quoted = in_double | in_single | double_marks | single_marks

    # Listed names between separators, blanks or the cell's edges keep their separators; longer names win.
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    guard = _guarded(lower, loose | blank, quoted, first, last, protected) if protected else np.zeros(n, bool)
    free = ~quoted & ~guard
    cut = loose & free
    for word in JOINERS:
        at = _find(lower, word)
        end = at + len(word)
        at = at[(at > first[at]) & (end <= last[at])]
        at = at[blank[at - 1] & blank[at + len(word)] & free[at]]
        _spread(cut, at, len(word))

    # Values: runs of bytes between cuts or cells' edges, from the first to the last that is no blank.
    inside = ~cut
    starts = inside & ((index == first) | np.concatenate(([True], cut[:-1])))
    run = np.cumsum(starts) - 1
    solid_at = np.flatnonzero(inside & (~blank | (quoted & ~double_marks & ~single_marks)))
    if not len(solid_at):
        return none
    owner = run[solid_at]
    new = np.concatenate(([True], owner[1:] != owner[:-1]))
    begin = solid_at[new]
    stop = solid_at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(owner) - 1]))] + 1

    # Enclosing quotes go; so do blanks within them at the edges, doubled quotes and the backslashes of escapes.
    mark = data[begin]
    alike = (stop - begin >= 2) & (data[stop - 1] == mark)
    marked = ((mark == 34) & double_marks[begin] & double_marks[stop - 1]) | ((mark == 39) & single_marks[begin] & single_marks[stop - 1])
    # Two quotes with nothing between them are an empty slot.
    empty = (stop - begin == 2) & ((mark == 34) | (mark == 39)) & ~escaped[begin] & ~escaped[stop - 1]
    closed = alike & (marked | empty)
    begin, stop = begin + closed, stop - closed
    lead = np.minimum(np.where(begin < n, np.where(blank[np.minimum(begin, n - 1)], after[np.minimum(begin, n - 1)], begin), n), stop)
    begin = np.where(closed, lead, begin)
    stop = np.where(closed & (stop > begin), np.where(blank[stop - 1], prev[stop - 1] + 1, stop), stop)
    keep_value = stop > begin
    begin, stop, closed, mark = begin[keep_value], stop[keep_value], closed[keep_value], mark[keep_value]
    if not len(begin):
        return none
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, stop, -1)
    kept = np.cumsum(edges[:-1]) > 0
    # A backslash that escapes the next byte goes.
    escape = np.zeros(n, bool)
    escape[:-1] = escaped[1:] & (cell[1:] == cell[:-1])
    kept &= ~(escape & slash)
    value_of = np.cumsum(np.bincount(begin, minlength=n)) - 1
    quote_of = np.where(closed, mark, 0)[np.maximum(value_of, 0)]
    twin = (data == quote_of) & ~escaped & (quote_of > 0) & kept
    pair = np.zeros(n, bool)
    pair[1:] = twin[1:] & twin[:-1]
    run_start = np.maximum.accumulate(np.where(~twin, index, -1))
    kept &= ~(pair & ((index - run_start) % 2 == 0))

    counts = np.add.reduceat(kept.astype(np.int64), begin)
    over = np.concatenate(([0], np.cumsum(kept)))
    counts = over[stop] - over[begin]
    rows = cell[begin]
    fresh = np.concatenate(([True], rows[1:] != rows[:-1]))
    index_of = np.arange(len(rows))
    position = index_of - np.maximum.accumulate(np.where(fresh, index_of, 0)) + 1
    return data[kept], np.concatenate(([0], np.cumsum(counts))), rows, position.astype(np.int32)


def split_strings(cells: pa.Array, protected: list[bytes]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The values of all cells as a flat array, the ordinals of their cells and their positions."""
    cells = cells.cast(pa.large_string())
    if cells.null_count:
        cells = cells.fill_null("")
    offsets = np.frombuffer(cells.buffers()[1], np.int64, len(cells) + 1, cells.offset * 8).copy()
    body = cells.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    out, ends, rows, position = split_buffer(data, offsets - offsets[0], protected)
    # The list array of all cells; its flattening and its parents are what the caller joins with the other columns.
    values = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))
    lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(cells))))).astype(np.int64), values)
    return lists.flatten().cast(pa.string()), pa.array(rows), position


def listed(names: DataFrame, field_col: str = "field_name", name_col: str = "listed_name", max_rows: int = BROADCAST_ROWS) -> dict[str, list[bytes]]:
    """By field, the listed names that hold separators. They are few: of names in prose only these go to the scan."""
    holding = names.select(F.col(field_col).alias("f"), F.col(name_col).alias("v")).filter(F.col("v").rlike(HOLDS)).distinct()
    if not small_enough(holding, max_rows):
        raise ValueError(f"more than {max_rows} listed names hold separators; split them over several calls by field")
    out: dict[str, list[bytes]] = {}
    for f, v in holding.collect():
        if f is not None and v.strip():
            out.setdefault(f, []).append(v.strip().encode().lower())
    return out


def unpack(df: DataFrame, cell_col: str, field_col: str, protected: dict[str, list[bytes]], keep: list[str], pos_col: str = "pos", value_col: str = "item_value") -> DataFrame:
    """One row per value of cell_col, with the columns `keep`, the position from 1 and the value.

    field_col names the list of protected names that holds for a row. Null, blank, '*' and '-' cells have no rows; empty
    slots don't count; equal values all count. A quote that is never closed, or stands within a value, is an
    ordinary character. Other columns of
    df are left out, whatever their names. An empty df gives no rows.
    """
    kept = df.filter(holds_value(F.col(cell_col))).select(*[F.col(f"`{c}`") for c in keep], F.col(cell_col).alias("__cell"), F.col(field_col).alias("__field"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)]) + f", `{pos_col}` int, `{value_col}` string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            field = whole.column("__field").combine_chunks()
            kinds = field.unique().to_pylist()
            for kind in kinds:
                part = whole if len(kinds) == 1 else whole.filter(pa.compute.equal(field, kind) if kind is not None else pa.compute.is_null(field))
                cells = part.column("__cell").combine_chunks()
                values, rows, pos = split_strings(cells, protected.get(kind, []))
                if len(values):
                    columns = [part.column(c).take(rows).combine_chunks() for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(pos, pa.int32()), values], [*keep, pos_col, value_col])

    return kept.mapInArrow(scan, schema)
