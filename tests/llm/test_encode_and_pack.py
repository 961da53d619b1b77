import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adit.llm.encode import TOKENIZERS, count_tokens, decode_ids, encode_corpus, encode_text, encoding
from adit.llm import packing
from adit.llm.packing import best_plan, pack, plan

ENC = encoding()
ALPHABET = "ab 'sxyz019\n\t  !?漏洞‍\x1c　=é"


def whole(text):
    return ENC.encode_to_numpy(text, disallowed_special=())


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=400), st.integers(2, 60))
def test_tree_is_the_whole(text, leaf):
    ids = encode_text(text, ENC, leaf)
    assert np.array_equal(ids, whole(text))
    assert decode_ids(ids, ENC) == text


@pytest.mark.parametrize("pool", ["漏洞可攻击", "ab", "a", " ", "= ", "12", "'s", "x'", "-", "漏a"])
def test_long_runs(pool):
    rnd = random.Random(5)
    text = "start " + "".join(rnd.choice(pool) for _ in range(9000)) + " end"
    assert np.array_equal(encode_text(text, ENC, 1000), whole(text))


def test_against_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("<|endoftext|> it's 2024!", "naïve  \n\n text\t漏洞", "a" * 700, "x   y"):
        assert encode_text(text, ENC, 8).tolist() == t.encode(text, add_special_tokens=False).ids


def test_frames(spark, rows):
    df = spark.createDataFrame([(1, "hello <|endoftext|>", [9]), (2, None, None), (3, "", None), (1, "hello <|endoftext|>", [9])], "doc_id bigint, text string, ids array<int>")
    got = encode_corpus(df).collect()
    assert [r.ids for r in got if r.doc_id in (2, 3)] == [[], []] and len(got) == 4
    assert 50256 not in got[0].ids
    assert [r[1] for r in rows(count_tokens(df))] == [len(got[0].ids)] * 2
    assert encode_corpus(df.limit(0)).count() == 0


def check_plan(histogram, capacity):
    runs, containers, *_ = best_plan(dict(histogram), capacity)
    load, seen = Counter(), Counter()
    for r in runs:
        for k in range(r.low, r.high):
            load[r.container + (k - r.low) // r.each] += r.size
            seen[r.size, k] += 1
    assert all(v == 1 for v in seen.values()) and len(seen) == sum(histogram.values())
    assert max(load.values(), default=0) <= capacity and len(load) <= containers
    return len(load), -(-sum(s * n for s, n in histogram.items()) // capacity)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=25))
def test_plan_is_valid(histogram):
    check_plan(histogram, 100)


def test_plan_is_tight():
    rnd = random.Random(1)
    for low, high in ((1, 2048), (300, 1500), (900, 1100), (1, 200)):
        used, least = check_plan(Counter(rnd.randint(low, high) for _ in range(5000)), 2048)
        # Above half of the capacity no two fit: a container each is the best there is.
        assert used <= 1.03 * least + 1 or low == 900
    # Small sizes fill what the grouping leaves: it is as tight as best fit alone, which `large=1` is.
    skewed = Counter(min(2048, int(rnd.lognormvariate(5.6, 1.0)) + 1) for _ in range(8000))
    assert check_plan(skewed, 2048)[0] <= plan(dict(skewed), 2048, large=1.0)[1]
    assert check_plan({1024: 1000}, 2048) == (500, 500)
    assert check_plan({2048: 7, 683: 6, 682: 3}, 2048)[0] <= 10


def test_pack(spark):
    sizes = [(1, 5000), (2, 100), (3, 0), (4, None), (5, 2048), (6, 2049), (7, 100), (7, 100), *((10 + k, 700) for k in range(300))]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").withColumnRenamed("x", "rank")
    got = pack(df).collect()
    load = Counter()
    for r in got:
        load[r.container_id] += r.n_tokens
        assert r.token_to - r.token_from == r.n_tokens
    assert max(load.values()) <= 2048
    parts = sorted((r.part_no, r.token_from, r.token_to) for r in got if r.doc_id == 1)
    assert parts == [(0, 0, 2048), (1, 2048, 4096), (2, 4096, 5000)]
    assert sum(load.values()) == sum(n or 0 for _, n in sizes) and not {r.doc_id for r in got} & {3, 4}
    assert pack(df.limit(0)).count() == 0


def test_a_size_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 50)
    df = spark.createDataFrame([(k, 300 if k % 3 else 10 + k % 90) for k in range(1500)], "doc_id bigint, n_tokens bigint")
    load, seen = Counter(), set()
    for r in pack(df, capacity=1000).collect():
        load[r.container_id] += r.n_tokens
        seen.add(r.doc_id)
    assert len(seen) == 1500 and max(load.values()) <= 1000 and sum(load.values()) / len(load) > 960
