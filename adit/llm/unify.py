"""One form for texts that look the same.

Most of a corpus is in this form already. A quick check, an expression of the character classes that normalization could
change, isolates the words and blanks that may be unstable; only they are normalized, with what they need around them
(the base letter of an accent, the whole word of a look-alike letter), and spliced into the unchanged text. Texts of
plain ASCII are settled before any Python runs.

What is unified: composed and decomposed accents; full-width and half-width forms, ligatures and other spellings of
letters as one code point; kinds of blanks; line ends; hyphens that differ in breaking; invisible characters; letters
of another script that look the same. A joiner within an emoji sequence changes what is seen and stays, and so do
superscripts, fractions, different dashes and different quotes. Look-alike letters become the script of the letters of
their word that have none; a word of look-alikes only takes the script of the word before it, else of the one after,
else Latin. All of this depends on the look alone, so that texts of equal look get equal forms.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.runtime import cut, small_enough

#: Letters that look like a plain Latin letter, each with that letter.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s",
    "і": "i", "ј": "j", "Ѵ": "V", "ѵ": "v", "Ү": "Y", "Һ": "H", "һ": "h", "Ӏ": "I", "ӏ": "l", "ԁ": "d", "Ԛ": "Q",
    "ԛ": "q", "Ԝ": "W", "ԝ": "w",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "Ϳ": "J", "ϳ": "j", "Ϲ": "C", "ϲ": "c",
}
LATIN = {"ɑ": "a", "ɡ": "g"}
#: Invisible characters. The zero-width joiner is handled apart, since it shapes emoji.
INVISIBLE = (
    r"\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb"
    r"\U000e0000-\U000e0fff"
)
BLANKS = r"\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
BREAKS = r"\r\x0b\x0c\u0085\u2028\u2029"
#: Hyphens that differ only in whether a line may end there.
HYPHENS = {"\u2010": "-", "\u2011": "-"}
#: Kinds of compatibility decomposition under which a character looks as what it decomposes to.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

_GONE = re.compile(f"[{INVISIBLE}]")
_LOOSE_JOINER = regex.compile(r"(?<!\p{Extended_Pictographic}\p{Emoji_Modifier}?)\u200d|\u200d(?!\p{Extended_Pictographic})")
_BLANK = re.compile(f"[{BLANKS}]")
_BREAK = re.compile(f"\r\n|[{BREAKS}]")
_ABOVE = re.compile("[\U00010000-\U0010ffff]")
_OTHER = re.compile("[\u0370-\u052f\u1c80-\u1c8f\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_TWINS = "".join(sorted(set(CYRILLIC.values()) | set(GREEK.values())))
_TO_LATIN = str.maketrans(CYRILLIC | GREEK)
# Of several letters that look like one Latin letter, a word takes the first.
_TO_CYRILLIC = str.maketrans({x: c for c, x in reversed(CYRILLIC.items())})
_TO_GREEK = str.maketrans({x: c for c, x in reversed(GREEK.items())})
#: A letter without a twin in another script tells the script of its word; twins that few alphabets have hint at Latin.
_TELLS = {k: regex.compile(p) for k, p in (("L", rf"(?V1)[\p{{Latin}}--[{_TWINS}]]"), ("C", r"\p{Cyrillic}"), ("G", r"\p{Greek}"), ("hint", "[SIJsijQWVqwvhdl]"), ("any", r"\p{L}"))}


@lru_cache(1)
def forms() -> dict[str, str]:
    """Characters that are another form of others, by rule from the character database: width forms, ligatures, letter pairs, numerals of letters."""
    out = HYPHENS | LATIN
    for code in range(0xA0, sys.maxunicode + 1):
        kind, *rest = unicodedata.decomposition(chr(code)).split() or [""]
        to = "".join(chr(int(x, 16)) for x in rest) if kind.startswith("<") else ""
        # Letters of Latin and Greek with a form of their own (a long s, a curled beta) don't look as what they stand for.
        letters = kind == "<compat>" and to.isalpha() and (len(to) > 1 or not unicodedata.name(chr(code), "").startswith(("LATIN", "GREEK")))
        if to and (kind in SAME_LOOK or letters) and not to.isspace():
            out[chr(code)] = HYPHENS.get(to, unicodedata.normalize("NFC", to))
    return out


@lru_cache(2)
def _unstable(above: bool) -> re.Pattern:
    """The quick check: runs of accents and other characters that normalization may change.

    Without code points above U+FFFF the class is a bit map, which is much faster.
    """
    table, codes = forms(), []
    for code in range(0xA0, sys.maxunicode + 1 if above else 0x10000):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind not in ("Cn", "Cs", "Co") and (kind[0] == "M" or 0x1100 <= code < 0x1200 or ch in table or unicodedata.normalize("NFC", ch) != ch):
            codes.append(code)
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return re.compile("[" + "".join(f"{re.escape(chr(x))}-{re.escape(chr(y))}" for x, y in ranges) + "]+")


def _splice(text: str) -> str:
    """Normalize the unstable runs, each with the character before it, which accents may join."""
    table, pieces, last = forms(), [], 0
    for m in _unstable(bool(_ABOVE.search(text))).finditer(text):
        begin = max(last, m.start() - 1)
        pieces.append(text[last:begin])
        last = m.end()
        pieces.append(unicodedata.normalize("NFC", "".join(table.get(c, c) for c in text[begin:last])))
    pieces.append(text[last:])
    return "".join(pieces)


@lru_cache(1 << 16)
def _looks(word: str) -> tuple[str, str, str, str]:
    """The script that a word's look tells ('' if it follows others, '-' if it has no letters) and its Latin, Cyrillic and Greek forms."""
    skeleton = unicodedata.normalize("NFD", word).translate(_TO_LATIN)
    told = next((k for k in "LCG" if _TELLS[k].search(skeleton)), None) or ("L" if _TELLS["hint"].search(skeleton) else "" if _TELLS["any"].search(skeleton) else "-")
    return told, *(unicodedata.normalize("NFC", x) for x in (skeleton, skeleton.translate(_TO_CYRILLIC), skeleton.translate(_TO_GREEK)))


def _scripts(text: str) -> str:
    """Look-alike letters in the script of their surroundings; text is otherwise in its form."""
    pieces: list[str] = []
    waiting: list[tuple[int, tuple]] = []
    last, script = 0, ""
    for m in _WORD.finditer(text):
        pieces.append(text[last : m.start()])
        last = m.end()
        looks = _looks(m[0])
        if looks[0] == "-":
            pieces.append(looks[1])
            continue
        script = looks[0] or script
        if script:
            for at, w in waiting:
                pieces[at] = w["LCG".index(script) + 1]
            waiting.clear()
        else:
            waiting.append((len(pieces), looks))
        pieces.append(looks["LCG".index(script or "L") + 1])
    pieces.append(text[last:])
    return "".join(pieces)


def unify(text: str | None) -> str | None:
    """The one form of all texts that look as this one."""
    if not text:
        return text
    text = _GONE.sub("", text)
    text = _BREAK.sub("\n", text)
    text = _BLANK.sub(" ", text)
    if text.isascii():
        return text
    if "\u200d" in text:
        text = _LOOSE_JOINER.sub("", text)
    text = _splice(text)
    return _scripts(text) if _OTHER.search(text) else text


def unified(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_col, text_col and unified_text. A null text stays null, an empty one empty. Other columns are ignored."""
    key, text = F.col(f"`{key_col}`"), F.col(f"`{text_col}`")
    kinds = f"`{key_col}` {docs.schema[key_col].dataType.simpleString()}, `{text_col}` string, unified_text string"
    # Printable ASCII with plain line ends has one form.
    plain = text.isNull() | ~text.rlike(r"[^\n\x20-\x7E]")
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([unify(t) for t in part.column(1).to_pylist()], pa.string())], [key_col, text_col, "unified_text"])

    return rows.filter(plain).withColumn("unified_text", text).unionByName(rows.filter(~plain).mapInArrow(run, kinds))


#: A text that more rows hold is divided into slices of about so many where pairs are made.
SLICE = 50_000


def _mark(c: Column) -> Column:
    """The first 16 bytes of the SHA-256."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def look_classes(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its look and its text: key_col, look, text_mark. Rows of equal look look the same; of these, rows of
    equal text_mark have equal texts.

    Marks are the first 16 bytes of the SHA-256 of the text's form and of the text. Texts without a visible character,
    null texts among them, have no row.
    """
    forms = unified(docs, key_col, text_col).filter(F.col("unified_text").rlike(r"[^\s]"))
    return forms.select(F.col(f"`{key_col}`"), _mark(F.col("unified_text")).alias("look"), _mark(F.col(f"`{text_col}`")).alias("text_mark"))


def look_alikes(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of rows with different texts of the same look: `{key}_a` < `{key}_b`.

    Texts without a visible character, null texts among them, have no pairs, nor have equal texts with each other. Pairs
    are made of the different texts of a look first, and only these meet the rows, so that copies are never compared; a
    text of many rows is divided into slices. What the joins give is the result, and no group is collected.
    """
    marks = cut(look_classes(docs, key_col, text_col).withColumnRenamed(key_col, "k"), "looks")
    return _pairs(marks, key_col)


def _pairs(marks: DataFrame, key_col: str, slice_rows: int = SLICE) -> DataFrame:
    """Rows (k, look, text_mark) to the pairs within a look whose texts differ."""
    texts = marks.groupBy("look", "text_mark").agg(F.count("*").alias("n"))
    mixed = texts.groupBy("look").agg(F.count("*").alias("texts")).filter("texts > 1").select("look")
    # Each text of a look of several, with the number of slices of its rows.
    kept = cut(texts.join(mixed, "look", "left_semi").withColumn("slices", F.ceil(F.col("n") / slice_rows).cast("int")), "texts")
    few = small_enough(kept)
    side = kept.select("look", "text_mark", "slices")
    rows = marks.join(F.broadcast(side) if few else side, ["look", "text_mark"]).select("k", "text_mark", "look", F.pmod(F.xxhash64("k"), F.col("slices")).cast("int").alias("slice"))
    a, b = (kept.select("look", F.col("text_mark").alias(f"t{x}"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias(f"s{x}")) for x in (1, 2))
    met = a.join(b, "look").filter("t1 < t2")
    for x in (1, 2):
        met = met.join(rows.select("look", F.col("text_mark").alias(f"t{x}"), F.col("slice").alias(f"s{x}"), F.col("k").alias(f"k{x}")), ["look", f"t{x}", f"s{x}"])
    return met.select(F.least("k1", "k2").alias(f"{key_col}_a"), F.greatest("k1", "k2").alias(f"{key_col}_b"))
