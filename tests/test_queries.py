import pytest

from adit.plans import domain, problems

SQL = {**domain.SQL, **problems.SQL}
QUERIES = {**domain.QUERIES, **problems.QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, compare):
    compare(name, QUERIES, SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_ranks_add_up(spark):
    from pyspark.sql import functions as F

    from adit.operators.graph import pagerank

    e = spark.createDataFrame([("a", "r", "x"), ("b", "r", "x"), ("c", "r", "y"), ("a", "r", "y"), ("a", "q", "x")], "src string, rel string, dst string")
    p = {r.id: r.rank for r in pagerank(e, rounds=60).collect()}
    assert abs(sum(p.values()) - 1) < 1e-9 and max(p, key=p.get) in ("a", "x")
    assert pagerank(e.limit(0)).agg(F.count("*")).first()[0] == 0


def test_betweenness_of_a_path(spark):
    from adit.operators.graph import betweenness

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = {r.id: round(r.betweenness, 6) for r in betweenness(e).collect()}
    assert got == {"a": 0.0, "b": 0.666667, "c": 0.666667, "d": 0.0}


def test_betweenness_against_paths_counted_one_by_one(spark):
    import random
    from collections import deque

    from adit.operators.graph import betweenness

    r = random.Random(6)
    pairs = {(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(40)} | {("x", "y")}
    around = {}
    for a, b in pairs:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)

    def paths(s):
        far, ways, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            v = queue.popleft()
            for w in around[v]:
                if w not in far:
                    far[w], ways[w] = far[v] + 1, 0
                    queue.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
        return far, ways

    every = {v: paths(v) for v in around}
    n, want = len(around), dict.fromkeys(around, 0.0)
    for s in around:
        for t in around:
            if s != t and t in every[s][0]:
                for v in around:
                    if v not in (s, t) and v in every[s][0] and t in every[v][0] and every[s][0][v] + every[v][0][t] == every[s][0][t]:
                        want[v] += every[s][1][v] * every[v][1][t] / every[s][1][t] / ((n - 1) * (n - 2))
    got = {x.id: x.betweenness for x in betweenness(spark.createDataFrame(sorted(pairs), "src string, dst string")).collect()}
    assert set(got) == set(want) and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert betweenness(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_similarity_by_hand(spark):
    """One shared weakness of two, two shared products of three, no pattern, scores 7 and 9."""
    from adit.operators.graph import similar_records

    e = [("a", "HAS_WEAKNESS", "w1"), ("b", "HAS_WEAKNESS", "w1"), ("b", "HAS_WEAKNESS", "w2"), *[("a", "AFFECTS", p) for p in "pqr"], *[("b", "AFFECTS", p) for p in "pq"], ("a", "HAS_ATTACK_PATTERN", "c1")]
    edges = spark.createDataFrame(e, "src string, rel string, dst string")
    scores = spark.createDataFrame([("a", 7.0), ("b", 9.0)], "src string, score double")
    got = similar_records(edges, scores, spark.createDataFrame([("a",)], "src string"), 5).collect()
    assert [(x.other, x.rank) for x in got] == [("b", 1)]
    assert got[0].similarity == round(0.4 * 1 / 2 + 0.3 * 2 / 3 + 0.1 * 0.8, 6)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
