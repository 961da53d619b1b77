import pytest
from pyspark.sql import functions as F

from adit.operators import retrieval as r


def search(vectors, query, n=10, **has):
    return r.search_records(vectors, r.Request(query, n, **has))


def test_retrieval(spark, tmp_path):
    cves = spark.read.parquet("/root/testdata/sf0.001/cves.parquet")
    vectors = r.vector_table(cves).cache()
    f = r.figures(vectors).first()
    assert f.n_records == cves.filter("cve_id IS NOT NULL").select("cve_id").distinct().count() and f.n_chunks >= f.n_records
    assert vectors.groupBy("chunk_id").count().filter("count > 1").count() == 0
    hits = search(vectors, "token cache " * 500, 50)
    assert hits.count() == min(50, f.n_chunks)
    severe = search(vectors, "token cache", 5, severity="HIGH")
    assert {x.severity for x in severe.collect()} <= {"HIGH"}
    some = vectors.filter(F.size("vendors") > 0).first()
    vendor = next(v for v in some.vendors if v)
    assert all(any(vendor in (v or "") for v in x.vendors) for x in search(vectors, "x", 5, vendor=vendor.upper()).collect())
    near = r.similar_to(vectors, some.cve_id, 3).collect()
    assert len(near) == 3 and some.cve_id not in {x.cve_id for x in near} and near[0].cosine >= near[-1].cosine
    assert r.similar_to(vectors, "none").count() == 0
    s = r.summary(search(vectors, "token", 50))
    assert sum(x.n for x in s["severities"].collect()) == min(50, f.n_chunks) and s["vendors"].count() <= 5
    with pytest.raises(ValueError):
        r.Request(" ")
    with pytest.raises(ValueError):
        r.Request("x", 51)
    path = f"{tmp_path}/v"
    assert r.keep_vectors(vectors, path).count() == f.n_chunks == r.keep_vectors(vectors.limit(3), path).count()
    assert r.keep_vectors(vectors.limit(3), path, force=True).count() == 3
    assert r.upserted(vectors, vectors.limit(2)).count() == f.n_chunks
    assert "Nothing found" in r.reply(hits.limit(0), "q").first().text and r.health(None) is None and r.health(vectors.limit(0)).first().status == "empty"
    vectors.unpersist()


def test_neighbours_in_blocks(spark, monkeypatch):
    """More blocks than one of either side give what a plain search gives; repeated and null vectors are no harm."""
    import numpy as np

    from adit.operators import vectors as v

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(z) for z in x[i]]) for i in range(60)] + [(99, None)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(v, "BLOCK", 13)
    got = {(r.query_id, r.rank): r.vec_id for r in v.neighbours(df, df.filter("vec_id % 2 = 1"), 4).collect()}
    for q in range(1, 60, 2):
        order = sorted((-float(x[q] @ x[i]), i) for i in range(60) if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in order]
    assert v.neighbours(df, df.limit(0), 3).count() == 0
