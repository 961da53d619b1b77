import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adit.llm.unify import look_alikes, unified, unify

SAME = [
    ("café", "café"),
    ("file 20.5", "ﬁle ２０．５"),
    ("запись", "зaпиcь"),
    ("Bec", "Вес"),
    ("a b", "a b"),
    ("a b", "a b"),
    ("a\nb", "a\r\nb"),
    ("ab", "a​­b﻿"),
    ("non-breaking", "non‑breaking"),
    ("ё", "ё"),
    ("ё", "ë"),
    ("ộ", "ộ"),
    ("ガ", "ｶﾞ"),
    ("Greek o", "Greek ο"),
    ("5 \u00b5m", "5 \u03bcm"),
    ("part I, II, x", "part \u2160, \u2161, \u2179"),
    ("help \u04bbelp", "\u04bbelp help"),
    ("I am", "\u04c0 am"),
    ("banana", "b\u0251n\u0251n\u0251"),
    ("quad word", "\u051bu\u0430d \u051dor\u0501"),
    ("no‍w", "now"),
]
DIFFERENT = [("cafe", "café"), ("a b", "a  b"), ("a\nb", "a b"), ("x2", "x²"), ("1", "2"), ("A", "a"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), ("a-b", "a—b"), ("и", "й"), ("abc", "abd"), ("1/2", "½"), ("s", "\u017f"), ("\u03b2", "\u03d0")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert unify(a) == unify(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert unify(a) != unify(b)


def test_readable():
    assert unify("он писал с кодом o") == "он писал с кодом о"
    assert unify("plain text") == "plain text" and unify(None) is None and unify("") == ""
    assert unify("Сору this") == "Copy this"


@settings(max_examples=200, deadline=None)
@given(st.text("aeoc аеос пи é́̈​ﬁＡАо ", max_size=40))
def test_stable(text):
    assert unify(unify(text)) == unify(text)


def test_frames(spark, rows):
    texts = [(1, "café"), (2, "café"), (3, "café"), (4, "cafe"), (5, None), (6, ""), (7, " "), (8, " "), (9, "x"), (10, "x"), (11, "x​" * 50_000), (12, "x" * 50_000)]
    df = spark.createDataFrame([(a, b, "form") for a, b in texts], "doc_id bigint, text string, form string")
    assert rows(look_alikes(df)) == [(1, 2), (11, 12), (2, 3)]
    got = {r.doc_id: r.unified_text for r in unified(df).collect()}
    assert got[5] is None and got[6] == "" and got[8] == " " and got[2] == "café" and len(got) == len(texts)
    assert look_alikes(df.limit(0)).count() == 0


def test_slices_give_the_same_pairs(spark, rows):
    from adit.llm.unify import _pairs, look_classes

    docs = [(i, ["same", "s\u200bame", "same\u200b", "\u0455ame", "other"][i % 5 if i % 3 else 0]) for i in range(60)]
    marks = look_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).withColumnRenamed("doc_id", "k")
    want = {(a, b) for a, s in docs for b, t in docs if a < b and s != t and unify(s) == unify(t)}
    for size in (1, 7, 1000):
        assert rows(_pairs(marks, "doc_id", size)) == sorted(want, key=repr)


def test_latin_words_among_others():
    assert unify("он сказал hello all \u0430ll") == "он сказал hello all all"


def test_brute_force(spark, rows):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect() if r.text and r.text.strip()]
    forms = {}
    for i, t in docs:
        forms.setdefault(unify(t), []).append((i, t))
    want = {(min(a, b), max(a, b)) for g in forms.values() for a, s in g for b, t in g if s != t}
    from adit.llm.queries import QUERIES

    assert set(rows(QUERIES["p10_found"](spark, "/root/testdata/sf0.01"))) == want
