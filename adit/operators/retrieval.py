"""Retrieval over records: a table of chunk vectors, search with filters, similar records, summaries.

The functions take the place of a service: a caller that serves requests passes the text and the limits on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.functions.texts import chunks, density, shortened
from adit.operators.vectors import hashed_text, rounded, scored, search

#: Most results of a search.
MOST_RESULTS = 50


@dataclass(frozen=True)
class Request:
    """What a caller of a service asks: a text, how many results, and what they must have."""

    query: str
    top_k: int = 10
    severity: str | None = None
    vendor: str | None = None

    def __post_init__(self):
        if not self.query.strip():
            raise ValueError("the query is empty")
        if not 1 <= self.top_k <= MOST_RESULTS:
            raise ValueError(f"top_k must be from 1 to {MOST_RESULTS}")


def record_chunks(cves: DataFrame) -> DataFrame:
    """chunk_id, cve_id, chunk_no, text, severity, vendors, weaknesses.

    The text of a record is its embedding text, else its description, else a line that names it. Of equal chunk ids the
    first row by ingest_id counts. Records without an id are left out.
    """
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    text = F.coalesce(filled("text_for_embedding"), filled("description"), F.concat(F.lit("Record "), "cve_id"))
    rows = cves.filter("cve_id IS NOT NULL").select("ingest_id", "cve_id", F.col("cvss_v3.base_severity").alias("severity"), F.col("affected_vendors").alias("vendors"), F.col("cwe_refs").alias("weaknesses"), text.alias("t"))
    # Repeats go before texts are cut and hashed.
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("cve_id").orderBy("ingest_id"))).filter("k = 1")
    cut = first.select("cve_id", "severity", "vendors", "weaknesses", F.posexplode(chunks(F.col("t"))).alias("chunk_no", "text"))
    return cut.withColumn("chunk_id", F.concat("cve_id", F.lit("_chunk_"), "chunk_no")).select("chunk_id", "cve_id", "chunk_no", "text", "severity", "vendors", "weaknesses")


def vector_table(cves: DataFrame, size: int = 64) -> DataFrame:
    """record_chunks with an embedding of length 1, from hashed words."""
    return hashed_text(record_chunks(cves), "text", size)


def keep_vectors(new: DataFrame, path: str, force: bool = False) -> DataFrame:
    """The stored vectors of a path: written if there are none yet, or if forced; else left as they are."""
    from adit.sources.readers import exists

    spark = new.sparkSession
    if force or not exists(spark, f"{path}/_SUCCESS"):
        new.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The vectors of both; of equal keys the new one. Rows are told apart by key, so that vectors don't meet."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def vector_of(vectors: DataFrame, text: str) -> list[float]:
    """The vector of a text, of the size of the table's."""
    spark = vectors.sparkSession
    size = vectors.select(F.size("embedding")).first()
    one = spark.createDataFrame([(text,)], "text string")
    return list(hashed_text(one, "text", size[0] if size else 64).first().embedding)


def having(vectors: DataFrame, severity: str | None = None, vendor: str | None = None) -> DataFrame:
    """Rows of a severity, and with a vendor that contains a term, whatever the case."""
    rows = vectors if severity is None else vectors.filter(F.col("severity") == severity)
    return rows if vendor is None else rows.filter(F.exists("vendors", lambda v: F.contains(F.lower(v), F.lit(vendor.lower()))))


def search_near(vectors: DataFrame, vector: list[float], n: int = 10, severity: str | None = None, vendor: str | None = None) -> DataFrame:
    """The n chunks nearest to a vector, at most 50, of those that have what is asked for; filters come first."""
    return search(having(vectors, severity, vendor), vector, n, MOST_RESULTS, "chunk_id")


def search_records(vectors: DataFrame, request: Request) -> DataFrame:
    """The best chunks for a request."""
    return search_near(vectors, vector_of(vectors, request.query.strip()), request.top_k, request.severity, request.vendor)


#: Share of likeness in a blend with words.
LIKENESS = 0.7


def hybrid(vectors: DataFrame, vector: list[float], words: str, n: int = 10, share: float = LIKENESS) -> DataFrame:
    """The n chunks of the greatest blend of cosine and density of words; blends that differ less than 1e-9 rank by chunk."""
    lexical = F.round(density(F.col("text"), words), 9)
    both = scored(vectors, vector).withColumn("blend", F.round(F.col("cosine") * share + lexical * (1 - share), 9))
    return rounded(both.orderBy(F.desc("blend"), "chunk_id").limit(min(n, MOST_RESULTS))).withColumn("blend", F.round("blend", 6))


def similar_to(vectors: DataFrame, cve_id: str, n: int = 5) -> DataFrame:
    """The n records most like a record by its first chunk, without itself, each by its best chunk; no rows for an unknown one."""
    own = vectors.filter(F.col("cve_id") == cve_id).orderBy("chunk_no", "chunk_id").select("embedding").first()
    if own is None:
        return vectors.limit(0)
    near = scored(vectors.filter(F.col("cve_id") != cve_id), list(own[0]))
    rest = [c for c in near.columns if c not in ("cve_id", "embedding")]
    # The best chunk of each record by a partial aggregation, before anything is cut off; of equal ones the first by id.
    best = near.groupBy("cve_id").agg(F.max("cosine").alias("top"), F.min_by(F.struct(*rest), F.struct(-F.col("cosine"), F.col("chunk_id"))).alias("r"))
    return rounded(best.select("cve_id", "r.*").orderBy(F.desc("cosine"), "chunk_id").limit(n))


def summary(hits: DataFrame, most: int = 5) -> dict[str, DataFrame]:
    """What chunks that were found are about: severities, the commonest vendors and weaknesses."""
    commonest = lambda c: hits.select(F.explode(c).alias("name")).filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)
    severities = hits.groupBy(F.coalesce("severity", F.lit("UNKNOWN")).alias("severity")).agg(F.count("*").alias("n"))
    return {"severities": severities, "vendors": commonest("vendors"), "weaknesses": commonest("weaknesses")}


def reply(hits: DataFrame, question: str, most: int = 3, size: int = 200) -> DataFrame:
    """One text that answers with what was found, best first, when nothing can write a better one; says so if there is nothing."""
    best = hits.orderBy(F.desc("cosine"), "chunk_id").limit(most)
    line = F.concat(F.lit("- "), "cve_id", F.lit(" ("), F.coalesce("severity", F.lit("UNKNOWN")), F.lit("): "), shortened(F.col("text"), size))
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("o"), "chunk_id", line.alias("line")))).alias("a"))
    head = F.lit(f"Found for: {question}")
    return rows.select(F.when(F.size("a") > 0, F.concat_ws("\n", head, F.array_join(F.transform("a", lambda x: x["line"]), "\n"))).otherwise(F.lit(f"Nothing found for: {question}")).alias("text"))


def figures(vectors: DataFrame) -> DataFrame:
    """n_records and n_chunks, as one row."""
    return vectors.agg(F.countDistinct("cve_id").alias("n_records"), F.count("*").alias("n_chunks"))


def health(vectors: DataFrame | None) -> DataFrame | None:
    """Whether a table of vectors answers: status and n_chunks, as one row; None without a table."""
    return None if vectors is None else vectors.agg(F.count("*").alias("n_chunks")).select(F.when(F.col("n_chunks") > 0, "healthy").otherwise("empty").alias("status"), "n_chunks")
