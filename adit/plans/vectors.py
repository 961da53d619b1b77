"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from adit.operators import retrieval as r
from adit.operators import vectors as v
from adit.plans.registry import query
from adit.runtime import table

_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_COS = "list_inner_product(CAST(embedding AS DOUBLE[]), q) AS c"
_FIG = "round(c, 6) AS cosine, round(2 - 2 * round(c, 6), 6) AS distance, round(2 * round(c, 6) - 1, 6) AS score"


def _first(t):
    return list(t.orderBy("vec_id").select("embedding").first()[0])


@query(f"WITH {_Q}, s AS (SELECT vec_id, label, {_COS} FROM embeddings, q) SELECT vec_id, label, {_FIG} FROM s ORDER BY c DESC, vec_id LIMIT 10")
def knn(spark, d):
    """The ten nearest to the first vector."""
    t = table(spark, d, "embeddings")
    return v.search(t, _first(t), 10)


@query(f"WITH {_Q}, s AS (SELECT vec_id, label, {_COS} FROM embeddings, q WHERE label = 1) SELECT vec_id, label, {_FIG} FROM s ORDER BY c DESC, vec_id LIMIT 10")
def search_filtered(spark, d):
    """The same among the vectors of one label; the filter comes first."""
    t = table(spark, d, "embeddings")
    return v.search(t.filter("label = 1"), _first(t), 10)


@query(f"""WITH {_Q}, s AS (SELECT vec_id, label, {_COS} FROM embeddings, q ORDER BY c DESC, vec_id LIMIT 50) SELECT label, count(*) AS n, max(round(c, 6)) AS best FROM s GROUP BY label""")
def search_summary(spark, d):
    """Labels among the fifty nearest."""
    t = table(spark, d, "embeddings")
    return v.search(t, _first(t), 50).groupBy("label").agg(F.count("*").alias("n"), F.max("cosine").alias("best"))


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
 SELECT query_id, vec_id, round(c, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM p) WHERE rank <= 5""")
def similar_items(spark, d):
    """The five nearest of every vector whose id is divisible by 20, among all."""
    t = table(spark, d, "embeddings")
    return v.neighbours(t, t.filter(F.col("vec_id") % 20 == 0), 5)


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM x WHERE label = 0 GROUP BY i)),
 s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), m) AS c FROM embeddings, m WHERE label <> 0) SELECT vec_id, round(c, 6) AS confidence FROM s WHERE c > 0.0 ORDER BY c DESC, vec_id LIMIT 10""")
def vector_inference(spark, d):
    """What is most like the mean of label 0 without being of it."""
    return v.inferred(table(spark, d, "embeddings"), F.col("label") == 0, 0.0)


@query()
def text_vectors(spark, d):
    """Documents as hashed vectors."""
    return v.hashed_text(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "embedding")


#: Chunks of records: each row with the vector of its number.
_CHUNKS = """ch AS (SELECT cve_id || '_chunk_' || ingest_id AS chunk_id, cve_id, ingest_id AS chunk_no, coalesce(title, '') AS text, cvss_v3.base_severity AS severity, affected_vendors AS vendors, cwe_refs AS weaknesses, CAST(embedding AS DOUBLE[]) AS embedding
  FROM cves JOIN embeddings ON ingest_id = vec_id WHERE cve_id IS NOT NULL), q AS (SELECT embedding AS q, cve_id AS own FROM ch ORDER BY cve_id, chunk_no LIMIT 1)"""


def _chunks(spark, d):
    c = table(spark, d, "cves").filter("cve_id IS NOT NULL").join(table(spark, d, "embeddings"), F.col("ingest_id") == F.col("vec_id"))
    return c.select(
        F.concat("cve_id", F.lit("_chunk_"), "ingest_id").alias("chunk_id"), "cve_id", F.col("ingest_id").alias("chunk_no"), F.coalesce("title", F.lit("")).alias("text"), F.col("cvss_v3.base_severity").alias("severity"), F.col("affected_vendors").alias("vendors"), F.col("cwe_refs").alias("weaknesses"), "embedding"
    )


def _own(t):
    return t.orderBy("cve_id", "chunk_no").select("embedding", "cve_id").first()


@query(f"""WITH {_CHUNKS}, s AS (SELECT chunk_id, list_inner_product(embedding, q) AS c FROM ch, q WHERE severity = 'HIGH' AND len(list_filter(vendors, lambda v: contains(lower(v), 'a'))) > 0) SELECT chunk_id, {_FIG} FROM s ORDER BY c DESC, chunk_id LIMIT 20""")
def record_search(spark, d):
    """The twenty best chunks of one severity with a vendor that contains a term."""
    t = _chunks(spark, d)
    return r.search_near(t, list(_own(t)[0]), 20, "HIGH", "A").select("chunk_id", "cosine", "distance", "score")


@query(f"""WITH {_CHUNKS}, s AS (SELECT cve_id, chunk_id, list_inner_product(embedding, q) AS c FROM ch, q WHERE cve_id <> own), b AS (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY c DESC, chunk_id) AS k FROM s) SELECT cve_id, chunk_id, {_FIG} FROM b WHERE k = 1 ORDER BY c DESC, chunk_id LIMIT 60""")
def similar_by_vector(spark, d):
    """The sixty records most like the first one, each by its best chunk."""
    t = _chunks(spark, d)
    return r.similar_to(t, _own(t)[1], 60).select("cve_id", "chunk_id", "cosine", "distance", "score")


@query(f"""WITH {_CHUNKS}, h AS (SELECT * FROM (SELECT *, list_inner_product(embedding, q) AS c FROM ch, q) ORDER BY c DESC, chunk_id LIMIT 50),
 n AS (SELECT 'vendors' AS what, x AS name, count(*) AS n FROM (SELECT unnest(vendors) AS x FROM h) WHERE x IS NOT NULL GROUP BY x UNION ALL SELECT 'weaknesses', x, count(*) FROM (SELECT unnest(weaknesses) AS x FROM h) WHERE x IS NOT NULL GROUP BY x)
 SELECT 'severities' AS what, coalesce(severity, 'UNKNOWN') AS name, count(*) AS n FROM h GROUP BY 2 UNION ALL SELECT what, name, n FROM (SELECT *, row_number() OVER (PARTITION BY what ORDER BY n DESC, name) AS k FROM n) WHERE k <= 5""")
def record_summary(spark, d):
    """What the fifty best chunks are about."""
    t = _chunks(spark, d)
    parts = [p.select(F.lit(what).alias("what"), F.col(p.columns[0]).alias("name"), "n") for what, p in r.summary(r.search_near(t, list(_own(t)[0]), 50)).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {_CHUNKS}, h AS (SELECT *, row_number() OVER (ORDER BY c DESC, chunk_id) AS k FROM (SELECT *, list_inner_product(embedding, q) AS c FROM ch, q))
 SELECT 'Found for: x' || chr(10) || string_agg('- ' || cve_id || ' (' || coalesce(severity, 'UNKNOWN') || '): ' || CASE WHEN length(text) > 20 THEN text[1:20] || '...' ELSE text END, chr(10) ORDER BY k) AS text FROM h WHERE k <= 3""")
def retrieved_reply(spark, d):
    t = _chunks(spark, d)
    return r.reply(r.search_near(t, list(_own(t)[0]), 10), "x", 3, 20)


@query(f"WITH {_CHUNKS} SELECT count(DISTINCT cve_id) AS n_records, count(*) AS n_chunks, 'healthy' AS status FROM ch")
def retrieval_figures(spark, d):
    t = _chunks(spark, d)
    return r.figures(t).join(r.health(t), "n_chunks").select("n_records", "n_chunks", "status")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY ingest_id) AS k FROM cves WHERE cve_id IS NOT NULL),
 t AS (SELECT cve_id, coalesce(CASE WHEN trim(text_for_embedding) <> '' THEN text_for_embedding END, CASE WHEN trim(description) <> '' THEN description END, 'Record ' || cve_id) AS t FROM f WHERE k = 1),
 w AS (SELECT cve_id, t, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM t),
 c AS (SELECT cve_id, CASE WHEN len(w) <= 512 THEN [t] ELSE list_transform(range(0, len(w), 462), lambda i: array_to_string(w[i + 1:i + 512], ' ')) END AS c FROM w)
 SELECT cve_id || '_chunk_' || (k - 1) AS chunk_id, cve_id, md5(c[k]) AS text FROM c, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS k)""")
def record_chunks(spark, d):
    """Chunks of every record's text, else of its description, else of a line that names it; the first row of an id counts."""
    return r.record_chunks(table(spark, d, "cves")).select("chunk_id", "cve_id", F.md5("text").alias("text"))


@query(f"""WITH {_CHUNKS}, s AS (SELECT chunk_id, list_inner_product(embedding, q) AS c, round(((length(lower(text)) - length(replace(lower(text), 'advisory', ''))) / 8) / greatest(1, length(text))::DOUBLE, 9) AS w FROM ch, q)
 SELECT chunk_id, round(0.7 * c + 0.3 * w, 6) AS blend FROM s ORDER BY round(0.7 * c + 0.3 * w, 9) DESC, chunk_id LIMIT 10""")
def hybrid_search(spark, d):
    """The ten best chunks by a blend of likeness and of how densely a word stands in the text."""
    t = _chunks(spark, d)
    return r.hybrid(t, list(_own(t)[0]), "advisory", 10).select("chunk_id", "blend")
