"""Encoding a corpus with a public tokenizer, as a tree of joins.

A text is encoded by halves, down to leaves. Two neighbours are joined by re-encoding a window about their border that
grows until the tokens outside it can't depend on anything within:

* Words. The pattern that cuts a text into words never matches across a change from a character that is no blank to a
  blank, nor across a change of class (letter, digit, other), but for an apostrophe before letters. Such a place is a
  word's border whatever surrounds it, so tokens on either side don't depend on the other. A window between two of them
  is enough.
* Within one word. A list of tokens is the encoding of a word exactly if each pair of neighbours is the encoding of its
  own bytes (every merge that could cross a border would show in the pair). A window may end where that holds.

Joining is associative, so that any tree gives the same tokens as encoding the text at once; decoding concatenates.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published pattern of this family of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts up to this many characters are encoded at once.
LEAF = 4096
#: A word that reaches so far on both sides of a border is joined within.
LONG = 512
BATCH = 512

_S, _L, _N = r"\p{White_Space}", r"\p{L}", r"\p{N}"
_BORDER = regex.compile(
    rf"(?<=[^{_S}])(?={_S})|(?<={_L})(?=[^{_L}{_S}])|(?<={_N})(?=[^{_N}{_S}])|(?<=[^{_S}{_L}{_N}'])(?=[{_L}{_N}])|(?<=')(?={_N})"
)


@lru_cache(2)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tiktoken.Encoding:
    """A vocabulary from a folder, or as a file that was sent with the job (SparkContext.addFile)."""
    path = f"{folder}/{name}.tiktoken"
    with open(path if os.path.exists(path) else SparkFiles.get(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, enc: tiktoken.Encoding, leaf: int = LEAF) -> np.ndarray:
    if len(text) <= leaf:
        return enc.encode_to_numpy(text, disallowed_special=())
    middle = len(text) // 2
    return join(encode_text(text[:middle], enc, leaf), encode_text(text[middle:], enc, leaf), text, middle, enc)


def join(left: np.ndarray, right: np.ndarray, text: str, at: int, enc: tiktoken.Encoding) -> np.ndarray:
    """The encoding of text, of which left encodes text[:at] and right the rest."""
    grow = 16
    while True:
        low, high = max(0, at - grow), min(len(text), at + grow)
        # Look-behind and look-ahead need a character more than the window.
        before = [m.start() for m in _BORDER.finditer(text, max(0, low - 1), min(len(text), at + 1)) if low < m.start() < at]
        after = next((m.start() for m in _BORDER.finditer(text, at - 1, min(len(text), high + 1)) if at < m.start() < high), None)
        a = before[-1] if before else 0 if low == 0 else None
        b = after if after is not None else len(text) if high == len(text) else None
        if a is not None and b is not None:
            window = enc.encode_to_numpy(text[a:b], disallowed_special=())
            return np.concatenate((left[: _tail(left, len(text[a:at].encode()), enc)], window, right[_head(right, len(text[at:b].encode()), enc) :]))
        if grow >= LONG and (made := _join_word(left, right, text, at, a, b, grow, enc)) is not None:
            return made
        grow *= 2


def _tail(ids: np.ndarray, size: int, enc: tiktoken.Encoding) -> int:
    """Where the tokens of the last `size` bytes start."""
    i = len(ids)
    while size > 0:
        i -= 1
        size -= len(enc.decode_single_token_bytes(int(ids[i])))
    assert size == 0
    return i


def _head(ids: np.ndarray, size: int, enc: tiktoken.Encoding) -> int:
    """Where the tokens of the first `size` bytes end."""
    i = 0
    while size > 0:
        size -= len(enc.decode_single_token_bytes(int(ids[i])))
        i += 1
    assert size == 0
    return i


_CLASSES = tuple(regex.compile(p) for p in (r"\p{L}{2}", r"\p{N}{2}", r"[^\p{White_Space}\p{L}\p{N}']{2}"))


def _join_word(left: np.ndarray, right: np.ndarray, text: str, at: int, a: int | None, b: int | None, grow: int, enc: tiktoken.Encoding) -> np.ndarray | None:
    """Join within a word that reaches further than grow to the left (a is None), to the right (b is None) or both.

    None where the characters at the border don't prove that it is one word, or no window within it is proof enough.
    """
    if not any(c.match(text[at - 1 : at + 1]) for c in _CLASSES):
        return None
    token, piece = enc.decode_single_token_bytes, enc._encode_single_piece

    def bound(x: int, y: int) -> bool:
        return list(piece(token(int(x)) + token(int(y)))) == [x, y]

    for width in range(4, 33):
        i = len(left) - width if a is None else _tail(left, len(text[a:at].encode()), enc)
        j = width if b is None else _head(right, len(text[at:b].encode()), enc)
        if a is None and i <= 0 or b is None and j >= len(right):
            return None
        parts = b"".join(token(int(t)) for t in left[i:]), b"".join(token(int(t)) for t in right[:j])
        if a is None and len(parts[0]) > grow or b is None and len(parts[1]) > grow:
            return None
        if a is None and b is None:
            window = piece(parts[0] + parts[1])
        else:
            try:
                window = enc.encode_to_numpy((parts[0] + parts[1]).decode(), disallowed_special=())
            except UnicodeDecodeError:  # the window's open end is within a character
                continue
        if (a is not None or bound(left[i - 1], window[0])) and (b is not None or bound(window[-1], right[j])):
            return np.concatenate((left[:i], np.array(window, left.dtype), right[j:]))
    return None


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, part.column(1).to_pylist()


def encode_corpus(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key_col and ids array<int>, one row per row of docs.

    A null and an empty text both have the empty list. Strings of special tokens are ordinary text. Other columns are
    ignored; repeated keys keep their rows.
    """
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for part, texts in _batches(batches):
            ids = [encode_text(t, enc) if t else np.empty(0, np.uint32) for t in texts]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key_col, "ids"])

    return docs.select(F.col(f"`{key_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{key_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key_col and n_tokens, for texts that are neither null nor empty."""
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for part, texts in _batches(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(encode_text(t, enc)) for t in texts], pa.int64())], [key_col, "n_tokens"])

    full = docs.select(F.col(f"`{key_col}`"), F.col(f"`{text_col}`")).filter(F.length(f"`{text_col}`") > 0)
    return full.mapInArrow(run, f"`{key_col}` {kind}, n_tokens bigint")


def decode_ids(ids: list[int], enc: tiktoken.Encoding) -> str:
    """The text of a list of ids; decoding concatenates bytes, so it goes up the same tree."""
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8", "replace")
