"""Mapping free-entered names to a canonical list.

A value is first written plainly: percent codes and entities resolved, letters without accents and in one script, camel case taken
apart, legal forms and regions left out. An automaton over all canonical names and aliases then finds every mention that
starts and ends with a token; the longest of overlapping mentions wins. What has no mention goes to the similarity of its
token set to those of the entries, found by an index of tokens: the share of tokens, of both sides, that have a partner,
where a partner may be misspelt or abbreviated and counts less then. Order doesn't matter, and tokens that are written as
one are taken apart at a known token. A value that fits several entries equally well, or none enough, stays unmatched.

Values are mapped where they are, once per different value of a batch, so that neither the rows nor a hot value move.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.llm.unify import CYRILLIC, GREEK
from adit.runtime import small_enough

UNMATCHED = "UNMATCHED"
#: A list of at most so many rows goes to every task: about 3 KB of index for each name.
MOST_NAMES = 50_000
#: Legal forms and regions that don't tell companies apart, and values that stand for nobody.
LEGAL = frozenset(
    "inc incorporated ltd limited llc llp lp plc corp corporation company co gmbh ag kg kgaa ug se sa sas sarl srl spa bv nv ab oy as aps pty pvt sdn bhd the and".split()
)
REGIONS = frozenset("emea apac amer latam dach usa us uk eu international intl global worldwide holdings holding group".split())
#: Digits that stand for letters of their shape.
SHAPES = (str.maketrans("013457", "oleast"), str.maketrans("013457", "oieast"))
_PLAIN = str.maketrans(CYRILLIC | GREEK)
#: Tokens of at least so many letters may be misspelt by one edit, and by two; a shorter name by none, as initials are.
ONE_EDIT, TWO_EDITS, TELLING = 4, 12, 6
#: A token set needs this similarity to an entry's: one left out of two (2/3) is enough, one that differs of two (1/2) isn't.
SIMILAR = 0.6
#: What an abbreviation counts for a token.
ABBREVIATED = 0.8


def tokens(value: str) -> list[str]:
    """The tokens of a value in plain letters, without legal forms and regions; all tokens where nothing else is left."""
    text = unicodedata.normalize("NFKD", unescape(unquote(value.replace("+", " "))).translate(_PLAIN))
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf", "Cc") or c in "\t\n")
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text).lower().replace("_", " ")
    text = re.sub(r"\b((?:[^\W\d_]\.){2,})", lambda m: m[0].replace(".", "") + " ", text)
    found = [t for t in re.split(r"[\W_]+", text) if t]
    kept = [t for t in found if t not in LEGAL and t not in REGIONS]
    return kept or found


def distance(a: str, b: str, most: int) -> int:
    """Edits (a letter more, less, other, or two swapped) between a and b, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _deletes(key: str, edits: int) -> set[str]:
    out, last = {key}, {key}
    for _ in range(edits):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def abbreviates(short: str, word: str) -> bool:
    """Whether short is a beginning of word, or some of its letters in order from the first on, as in cld or sw."""
    if len(short) >= len(word) or len(short) < 2 or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


class Names:
    """A canonical list made ready: entries are (canonical name, other names)."""

    def __init__(self, entries: list[tuple[str, list[str]]]):
        by_key: dict[str, set[str]] = defaultdict(set)
        sets: dict[frozenset[str], set[str]] = defaultdict(set)
        second = set()
        canonical = {"".join(tokens(name)): name for name, _ in entries}
        for name, others in entries:
            for other in dict.fromkeys([name, *others]):
                t = tokens(other)
                key = "".join(t)
                # A canonical name is never another's alias.
                if not key or (other != name and canonical.get(key, name) != name):
                    continue
                by_key[key].add(name)
                sets[frozenset(t)].add(name)
                second.update(t[1:])
        self.by_key, self.second = dict(by_key), second
        self.automaton = ahocorasick.Automaton()
        for key in self.by_key:
            self.automaton.add_word(key, key)
        if self.by_key:
            self.automaton.make_automaton()
        # The index of tokens: the sets that hold a token, the tokens near a misspelling, the tokens by first letter.
        self.sets = list(sets.items())
        self.holders: dict[str, list[int]] = defaultdict(list)
        for i, (members, _) in enumerate(self.sets):
            for t in members:
                self.holders[t].append(i)
        self.near: dict[str, list[str]] = defaultdict(list)
        self.endings: dict[str, list[str]] = defaultdict(list)
        for t in self.holders:
            if len(t) >= ONE_EDIT:
                for d in _deletes(t, 2 if len(t) >= TWO_EDITS else 1):
                    self.near[d].append(t)
            if t in second:
                self.endings[t[0]].append(t)
        self.longest = max(map(len, self.holders), default=0)
        self.find = lru_cache(1 << 16)(self._find)

    def _find(self, value: str) -> str:
        t = tokens(value)
        if not t:
            return UNMATCHED
        for attempt in ([t] if not any(c.isdigit() for w in t for c in w) else [t, *([w.translate(s) for w in t] for s in SHAPES)]):
            if found := self._mention(attempt):
                return found
        return self._similar(t) or UNMATCHED

    def _one(self, names: set[str] | None) -> str | None:
        return next(iter(names)) if names and len(names) == 1 else None

    def _mention(self, t: list[str]) -> str | None:
        """The entry that all mentions name; None where a token tells of another company."""
        text = "".join(t)
        if not text or not self.by_key:
            return None
        if text in self.by_key:
            return self._one(self.by_key[text])
        edges, at = {0}, 0
        for w in t:
            at += len(w)
            edges.add(at)
        hits = [(end + 1 - len(key), end + 1, key) for end, key in self.automaton.iter(text) if end + 1 in edges and end + 1 - len(key) in edges]
        hits.sort(key=lambda h: (-len(h[2]), h[0]))
        taken: list[tuple[int, int, str]] = []
        for h in hits:
            if all(h[1] <= a or h[0] >= b for a, b, _ in taken):
                taken.append(h)
        names = set().union(*(self.by_key[k] for _, _, k in taken)) if taken else set()
        if len(names) != 1:
            return None
        at, left = 0, []
        for w in t:
            if not any(a <= at < b for a, b, _ in taken):
                left.append(w)
            at += len(w)
        if any(w in self.second or any(abbreviates(w, s) for s in self.second) for w in left):
            return None
        return next(iter(names))

    def _similar(self, t: list[str]) -> str | None:
        """The entry whose token set is most similar, if it is similar enough and the only one."""
        best, names = 0.0, set()
        for way in self._ways(t):
            for i, score in self._scores(way).items():
                if score > best + 1e-9:
                    best, names = score, set(self.sets[i][1])
                elif score > best - 1e-9:
                    names |= self.sets[i][1]
        return self._one(names) if best >= SIMILAR else None

    def _ways(self, t: list[str]) -> list[list[str]]:
        """The tokens as they are, and with one of them taken apart at a known token that it begins or ends with."""
        out = [t]
        for i, w in enumerate(t):
            if w in self.holders or len(w) > 4 * self.longest:
                continue
            for k in range(3, len(w) - 1):
                if (w[:k] in self.holders and k > 3) or w[k:] in self.second:
                    out.append([*t[:i], w[:k], w[k:], *t[i + 1 :]])
        return out

    def _partners(self, w: str) -> dict[str, float]:
        """The entries' tokens that w may stand for, with what it counts. A known token stands for itself only."""
        if w in self.holders:
            return {w: 1.0}
        out = {e: ABBREVIATED for e in self.endings.get(w[0], ()) if abbreviates(w, e) or abbreviates(e, w)}
        if ONE_EDIT <= len(w) <= self.longest + 2:
            for e in {e for d in _deletes(w, 2 if len(w) >= TWO_EDITS else 1) for e in self.near.get(d, ())}:
                most = 2 if len(e) >= TWO_EDITS else 1
                d = distance(w, e, most) if len(e) >= TELLING or e in self.second else most + 1
                if d <= most:
                    out[e] = max(out.get(e, 0.0), 1 - d / len(e))
        return out

    def _scores(self, t: list[str]) -> dict[int, float]:
        """The similarity to every token set that holds a partner of one of the rarer tokens: shares of partners, of both sides."""
        found = [self._partners(w) for w in dict.fromkeys(t)]
        # The kind of a business, as a partner, is in many sets; what tells companies apart is in few.
        telling = {e for p in found for e in p if e not in self.second} or {e for p in found for e in p}
        out = {}
        for i in {i for e in telling for i in self.holders[e]}:
            members, total, used = self.sets[i][0], 0.0, set()
            for p in found:
                e = max((e for e in p if e in members and e not in used), key=p.get, default=None)
                if e is not None:
                    used.add(e)
                    total += p[e]
                elif p and all(e in self.second for e in p):
                    break  # a kind that the entry hasn't tells of another company
            else:
                out[i] = 2 * total / (len(found) + len(members))
        return out


def canonical_names(nodes: DataFrame, name_col: str = "vendor_name", others: tuple[str, ...] = ("display_name",), aliases: str = "aliases", max_rows: int = MOST_NAMES) -> list[tuple[str, list[str]]]:
    """The entries of a list of names. The list goes to every executor: it is counted first, and refused beyond max_rows."""
    rows = nodes.filter(F.col(name_col).isNotNull()).select(name_col, F.array_compact(F.concat(F.array(*others), F.coalesce(aliases, F.array().cast("array<string>")))).alias("o")).distinct()
    if not small_enough(rows, max_rows):
        raise ValueError(f"more than {max_rows} names; map the values against parts of the list")
    merged: dict[str, list[str]] = {}
    for name, other in rows.collect():
        merged.setdefault(name, []).extend(x for x in other if x.strip())
    return sorted(merged.items())


def nobody(c: Column) -> Column:
    """Null, blank, '*' and '-' name nobody."""
    return c.isNull() | F.trim(F.regexp_replace(c, r"[\s\u00a0\u200b\ufeff]+", " ")).isin("", "*", "-")


def map_names(df: DataFrame, key_col: str, fields: list[str], entries: list[tuple[str, list[str]]], name_col: str = "vendor_name") -> DataFrame:
    """key_col, field_name, name_col for every value of `fields` that names somebody and isn't exactly canonical.

    name_col is a canonical name or 'UNMATCHED'. With an empty list everything is unmatched. Repeated rows each count;
    other columns are ignored.
    """
    kind = df.schema[key_col].dataType.simpleString()
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("value")) for f in fields])
    rows = df.select(F.col(f"`{key_col}`"), F.inline(cells)).filter(~nobody(F.col("value")))
    shared = df.sparkSession.sparkContext.broadcast(tuple((n, tuple(o)) for n, o in entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _ready(shared.value)
        exact = {name for name, _ in shared.value}
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            found = pa.array([None if v in exact else names.find(v) for v in coded.dictionary.to_pylist()], pa.string())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found.take(coded.indices)], [key_col, "field_name", name_col])
            yield out.filter(pa.compute.is_valid(out.column(2)))

    return rows.mapInArrow(run, f"`{key_col}` {kind}, field_name string, `{name_col}` string")


@lru_cache(2)
def _ready(entries: tuple) -> Names:
    return Names([(n, list(o)) for n, o in entries])
