import random
from itertools import combinations

import numpy as np
import pytest

from adit.llm import cooccur as c
from adit.llm.queries import QUERIES
from adit.llm.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, compare):
    compare(name, QUERIES, SQL, "/root/testdata/sf0.01")


@pytest.fixture
def baskets(spark):
    rnd = random.Random(3)
    data = []
    for i in range(400):
        items = {f"i{rnd.randint(0, 30)}" for _ in range(rnd.randint(1, 6))}
        if rnd.random() < 0.1:
            items |= {"p", "q"}
        data.append((f"b{i}", "f", sorted(items)))
    return data, spark.createDataFrame(data, "basket string, field_name string, items array<string>")


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("lift", [0, 2])
def test_counts(baskets, rows, few, lift, monkeypatch):
    data, df = baskets
    monkeypatch.setattr(c, "small_enough", lambda *_: few)
    n, one, two = len(data), {}, {}
    for _, _, items in data:
        for x in items:
            one[x] = one.get(x, 0) + 1
        for p in combinations(items, 2):
            two[p] = two.get(p, 0) + 1
    want = [("f", a, b, k, one[a], one[b], n) for (a, b), k in two.items() if k >= 3 and k >= 0.01 * n and k * n >= lift * one[a] * one[b]]
    assert rows(c.pair_counts(df, 3, 0.01, lift)) == sorted(want, key=repr)


def test_latest(spark, rows):
    df = spark.createDataFrame([("a", 1, 1, ["x", None, "x"], "z"), ("a", None, 9, ["y"], "z"), ("a", 1, 0, ["w"], "z"), (None, 5, 5, ["n"], "z"), ("b", 1, 2, [], "z"), ("c", 1, 3, None, "z")], "cve_id string, m int, i int, f array<string>, items string")
    assert rows(c.latest_baskets(df, order_cols=("m", "i"), fields=("f",))) == [("a", "f", ["x"])]
    assert c.pair_counts(c.latest_baskets(df.limit(0), order_cols=("m", "i"), fields=("f",))).count() == 0


def test_tail_against_exact():
    rng = np.random.default_rng(1)
    q = rng.uniform(0.001, 0.3, (5, 4))
    m = np.array([30.0, 50, 20, 10])
    n = np.array([4, 12, 25, 40, 60])
    mean, p = c.upper_tail(n, q, m)
    for k in range(5):
        dist = np.array([1.0])
        for s in range(4):
            for _ in range(int(m[s])):
                dist = np.convolve(dist, [1 - q[k, s], q[k, s]])
        exact = dist[n[k] :].sum()
        assert abs(mean[k] - q[k] @ m) < 1e-9
        assert p[k] == pytest.approx(exact, rel=0.08, abs=1e-12)


def test_null_has_the_margins():
    d, dc, s, sc = np.array([2.0, 10, 40]), np.array([50.0, 20, 5]), np.array([1.0, 4, 8]), np.array([100.0, 60, 32.5])
    sc[2] = (d @ dc - sc[0] - 4 * sc[1]) / 8
    x, y = c.fit_null(d, dc, s, sc, 5000)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ sc, d, rtol=1e-4) and np.allclose(dc @ p, s, rtol=1e-4)


def test_null_of_sure_items():
    # One item in all 50 baskets, ten items in five each; one basket holds everything.
    d, dc, s, sc = np.array([50.0, 5]), np.array([1.0, 10]), np.array([11.0, 2, 1]), np.array([1.0, 40, 9])
    x, y = c.fit_null(d, dc, s, sc)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ sc, d, rtol=1e-3) and np.allclose(dc @ p, s, rtol=1e-3)
    with pytest.raises(ValueError):
        c.fit_null(np.array([2.0, 10, 40]), np.array([50.0, 20, 5]), np.array([1.0, 4, 8]), np.array([100.0, 60, 32.5]), rounds=1)


def test_surprise_of_every_pair_by_hand(spark):
    """Expected counts, tails and step-up rates of a small field against the exact distribution."""
    rnd = random.Random(8)
    data = [sorted({f"i{rnd.randint(0, 6)}" for _ in range(rnd.randint(1, 4))} | ({"p", "q"} if k % 9 == 0 else set())) for k in range(120)]
    one = {x: sum(x in b for b in data) for b in data for x in b}
    d, dc = np.unique(np.array(list(one.values()), float), return_counts=True)
    s, sc = np.unique(np.array([len(b) for b in data], float), return_counts=True)
    x, y = c.fit_null(d, dc.astype(float), s, sc.astype(float))
    x_of, y_of = dict(zip(d, x)), dict(zip(s, y))
    exact = {}
    for a, b in combinations(sorted(one), 2):
        n = sum(a in k and b in k for k in data)
        if n >= 3:
            dist = np.array([1.0])
            for k in data:
                u, v = x_of[one[a]] * y_of[len(k)], x_of[one[b]] * y_of[len(k)]
                q = u / (1 + u) * v / (1 + v)
                dist = np.convolve(dist, [1 - q, q])
            exact[a, b] = (dist @ np.arange(len(dist)), dist[n:].sum())
    df = spark.createDataFrame([(str(i), "f", b) for i, b in enumerate(data)], "basket string, field_name string, items array<string>")
    got = {(r.item_a, r.item_b): r for r in c.surprise(df, 3, 0.001).collect()}
    assert set(got) == set(exact)
    for k, (mean, p) in exact.items():
        assert got[k].expected == pytest.approx(mean, rel=0.02)
        assert got[k].p_value == pytest.approx(p, rel=0.15, abs=0.03)
    tests, order = len(one) * (len(one) - 1) / 2, sorted(got.values(), key=lambda r: r.p_value)
    best = 1.0
    for rank in range(len(order), 0, -1):
        best = min(best, order[rank - 1].p_value * tests / rank)
        if order[rank - 1].p_value < 0.9:
            assert order[rank - 1].q_value == pytest.approx(best, rel=1e-6)


def test_surprise(baskets):
    _, df = baskets
    got = c.surprise(df, 3, 0.01).collect()
    ranked = sorted(got, key=lambda r: r.p_value)
    assert (ranked[0].item_a, ranked[0].item_b) == ("p", "q") and ranked[0].q_value < 1e-6
    # The step-up procedure, by hand.
    tests = None
    p = np.array([r.p_value for r in ranked])
    q = np.array([r.q_value for r in ranked])
    assert (np.diff(q) >= -1e-12).all() and (q >= p - 1e-12).all() and sum(q < 0.05) < 5 and tests is None
