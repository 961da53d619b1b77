import datetime as dt

import pytest
from pyspark.sql import functions as F

from adit.operators import orphans as o

D = lambda day: dt.datetime(2024, 1, day)


@pytest.fixture
def tables(spark):
    edges = spark.createDataFrame(
        [(1, " cwe-007", "A_b", D(5), "x"), (2, "CWE-7", "", D(1), "x"), (3, "8", None, D(20), "x"), (4, "cwe 9", "zz", D(2), "x"), (5, "cwe 9", "a B ", D(9), "x"), (5, "cwe 9", "a B ", D(9), "x"), (6, None, " ", D(9), "x"), (7, "7", None, None, "x"), (8, "10", None, D(9), "x")],
        "edge_id int, cwe_id string, product_name string, loaded_at timestamp, key string",
    )
    cwe = spark.createDataFrame([("CWE-7", D(3), None), ("CWE-8", D(1), D(10)), ("CWE-8", D(15), D(18)), (None, D(1), None), ("CWE-7", D(3), D(4)), ("CWE-10", None, None)], "cwe_id string, created_at timestamp, deleted_at timestamp")
    product = spark.createDataFrame([("a b", D(1), D(6)), ("A_B", D(8), None)], "product_name string, created_at timestamp, deleted_at timestamp")
    return edges, [o.Target("cwe_id", cwe, "cwe_id", o.number_key), o.Target("product_name", product, "product_name", o.name_key)]


WANT = [(2, "cwe_id", "late"), (3, "cwe_id", "deleted"), (4, "cwe_id", "missing"), (4, "product_name", "missing"), (5, "cwe_id", "missing"), (5, "cwe_id", "missing"), (8, "cwe_id", "deleted")]


def test_rows(tables, rows):
    edges, targets = tables
    got = rows(o.orphans(edges, targets).select("edge_id", "ref_field", "reason"))
    assert got == sorted(WANT, key=repr)
    assert rows(o.orphans(edges, targets).select("load_month").distinct()) == [("2024-01",)]


def test_skewed_path_is_the_same(tables, rows, monkeypatch):
    edges, targets = tables
    for heavy in (1, 3, 1000):
        monkeypatch.setattr(o, "small_enough", lambda *_: False)
        assert rows(o.orphans(edges, targets, heavy_cells=heavy).select("edge_id", "ref_field", "reason")) == sorted(WANT, key=repr)


def test_counts_agree_with_rows(tables, rows):
    edges, targets = tables
    edges = edges.filter(F.col("loaded_at").isNotNull())
    counts = o.orphan_counts(edges, targets)
    got = {(r.ref_field, r.load_month): (r.n_missing, r.n_late, r.n_deleted) for r in counts.collect()}
    assert got == {("cwe_id", "2024-01"): (3, 1, 2), ("product_name", "2024-01"): (1, 0, 0)}


def test_empty(spark, tables, rows):
    edges, targets = tables
    assert rows(o.orphans(edges.limit(0), targets)) == []
    bare = [o.Target("cwe_id", targets[0].rows.limit(0), "cwe_id", o.number_key)]
    assert {r.reason for r in o.orphans(edges, bare).collect()} == {"missing"}


@pytest.mark.parametrize("few", [0, 10**6])
def test_births_and_deaths_within_a_month_against_brute_force(spark, monkeypatch, few):
    """A key that holds most references and most target rows, with many lives, some equal to references' times to the second."""
    import random

    monkeypatch.setattr(o, "FEW_ROWS", few)
    r = random.Random(5)
    at = lambda: D(1) + dt.timedelta(minutes=r.randrange(3 * 1440) // r.choice([1, 60]) * 7, seconds=r.choice([0, 0, 30]))
    lives = [(r.choice(["hot", "hot", "hot", "b", "c"]), at(), r.choice([None, 1, 2, 2])) for _ in range(60)]
    lives = [(k, c, d and c + dt.timedelta(minutes=r.choice([0, 1, 9, 400, -5]))) for k, c, d in lives] + [("c", None, None)]
    refs = [(i, r.choice(["HOT", "hot", "hot ", "b", "c", "gone", None]), at()) for i in range(400)]
    edges = spark.createDataFrame(refs, "edge_id int, product_name string, loaded_at timestamp")
    target = o.Target("product_name", spark.createDataFrame(lives, "product_name string, created_at timestamp, deleted_at timestamp"), "product_name", o.name_key)
    want = {}
    for i, k, t in refs:
        own = [x for x in lives if k and x[0] == k.strip().lower()]
        if k and not any(c and c <= t and (d is None or d > t) for _, c, d in own):
            want[i] = "missing" if not own else "late" if all(c and c > t for _, c, _ in own) else "deleted"
    got = {x.edge_id: x.reason for x in o.orphans(edges, [target]).collect()}
    assert got == want and len(set(want.values())) == 3
    n = o.orphan_counts(edges, [target]).collect()
    assert sum(x.n_refs for x in n) == sum(k is not None for _, k, _ in refs)
    for kind in ("missing", "late", "deleted"):
        assert sum(x[f"n_{kind}"] for x in n) == sum(v == kind for v in want.values())
