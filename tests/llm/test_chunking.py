import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adit.llm.chunking import Limit, boundaries, limits, spans, split_oversized


def check(text, limit, overlap):
    parts = spans(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for a, b in parts:
        assert b - a <= limit
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert c <= b and b - c <= overlap and d > b and c > a
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n,́‍漏。\r", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_covers_everything(text, limit, overlap):
    check(text, limit, overlap)


@settings(max_examples=80, deadline=None)
@given(st.text("ab .\n", min_size=1, max_size=120), st.integers(3, 30), st.integers(0, 2), st.data())
def test_other_units(text, limit, overlap, data):
    sizes = np.array(data.draw(st.lists(st.integers(0, 5), min_size=len(text), max_size=len(text))))
    sums = np.concatenate(([0], np.cumsum(sizes)))
    parts = spans(text, limit, overlap, sizes)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for a, b in parts:
        assert sums[b] - sums[a] <= limit or b == a + 1
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert a < c <= b and sums[b] - sums[c] <= overlap


def test_natural_places():
    text = "One sentence here. Another one.\n\nA second paragraph with words. And an end."
    parts = [text[a:b] for a, b in check(text, 45, 0)]
    assert parts[0] == "One sentence here. Another one.\n\n"
    for a, b in check("word " * 200, 52, 10)[:-1]:
        assert b in set(boundaries("word " * 200)[-1].tolist())
    assert check("x" * 100, 40, 5)[0] == (0, 40)
    accents = "é" * 50
    assert all(b % 2 == 0 for _, b in check(accents, 31, 5))


def test_long_clusters_stay_whole():
    cluster = "e" + "\u0301" * 60
    for a, b in check(cluster * 20, 200, 70):
        assert a % 61 == 0 and (b % 61 == 0)
    check("e" + "\u0301" * 500, 100, 10)


def test_pieces_against_a_plain_search():
    """The same rules, tried place by place."""
    import random

    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(["ab", "c ", ". ", "\n", "\n\n", "漏", "。", "x" * 9]) for _ in range(80))
        limit, overlap = r.randint(8, 60), r.randint(0, 6)
        marks, want, start = [set(x.tolist()) for x in boundaries(text)], [], 0
        while len(text) - start > limit:
            end = 0
            for k, places in enumerate(marks):
                least = start + (max(overlap, -(-limit // 2)) if k < 3 else overlap)
                found = [p for p in range(start + 1, start + limit + 1) if p in places and p > least]
                if found:
                    end = found[-1]
                    break
            end = end or start + limit
            want.append((start, end))
            back = max(start + 1, end - overlap)
            start = next((p for p in range(back, end) if p in marks[-1]), back)
        want.append((start, len(text)))
        assert spans(text, limit, overlap) == want


def test_frame(spark, rows):
    long = "word " * 20_000
    df = spark.createDataFrame([(1, "abc def", None, "z"), (1, "abc def", None, "z"), (2, "", "abcdefghijk", "z"), (3, None, None, "z"), (4, long, "x", "z")], "id int, a string, b string, piece string")
    bounds = [Limit("a", 5, 1), Limit("b", 10, 0)]
    got = split_oversized(df, "id", bounds)
    by_key = {}
    for r in got.filter("id = 4").collect():
        assert long[r.start_pos : r.end_pos] == r.piece
        by_key[r.piece_no] = r
    assert by_key[max(by_key)].end_pos == len(long)
    assert rows(got.filter("id < 4").select("id", "field_name", "piece")) == [(1, "a", " def"), (1, "a", " def"), (1, "a", "abc "), (1, "a", "abc "), (2, "b", "abcdefghij"), (2, "b", "k")]
    assert split_oversized(df.limit(0), "id", bounds).count() == 0
    with pytest.raises(ValueError):
        Limit("a", 5, 5)
    sizes = spark.createDataFrame([("a", "chars", 5, 1), ("t", "tokens", 9, None)], "field_name string, unit string, max_size bigint, overlap bigint")
    assert limits(sizes) == [Limit("a", 5, 1)] and limits(sizes, "tokens") == [Limit("t", 9, 0)]
