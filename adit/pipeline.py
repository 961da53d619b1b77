"""From raw feeds to tables in one go: records, documents, edges and their figures, written under one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.operators import records as r
from adit.sources import readers, sinks


def edges_of(records: DataFrame) -> DataFrame:
    """Distinct edges (src, rel, dst) of enriched records to what their lists name."""
    lists = {"AFFECTS": "affected_products", "HAS_WEAKNESS": "cwe_ids", "HAS_ATTACK_PATTERN": "capec_entries", "USES_TECHNIQUE": "mitre_techniques", "BELONGS_TO_TACTIC": "parent_techniques"}
    cells = F.array(*[F.struct(F.lit(rel).alias("rel"), F.col(c).alias("names")) for rel, c in lists.items()])
    rows = records.select(F.col("cve_id").alias("src"), F.inline(cells)).select("src", "rel", F.explode("names").alias("dst"))
    return rows.filter(F.trim("dst") != "").distinct()


def run(spark: SparkSession, target: str, first: str | DataFrame | None = None, second: str | DataFrame | None = None, mapping: DataFrame | None = None, exploited: DataFrame | None = None) -> dict[str, DataFrame]:
    """Read feeds of either dialect, keep the latest record of each id, enrich them, and write records, documents (by year),
    edges and figures under `target`; the tables that were written, by name. What isn't given is empty."""
    feeds: list[tuple[Callable, Callable, str | DataFrame | None]] = [(readers.feed_1, r.normalised_1, first), (readers.feed_2, r.normalised_2, second)]
    parts = [normal(read(spark, source)) for read, normal, source in feeds if source is not None]
    if not parts:
        raise ValueError("no feed is given")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    pairs = lambda name: spark.createDataFrame([], f"cve_id string, {name} string")
    mapping = spark.createDataFrame([], "weakness string, capecs array<string>, mitre_techniques array<string>") if mapping is None else mapping
    exploited = spark.createDataFrame([], "id string") if exploited is None else exploited
    sinks.tables({"records": r.enriched(r.current(every), exploited, pairs("advisory_id"), pairs("exploit_id"), mapping)}, target)
    # What follows starts from the written records, so that the feeds are read once.
    records = spark.read.parquet(f"{target}/records")
    sinks.documents(r.documents_of(records), f"{target}/documents")
    sinks.tables({"edges": edges_of(records)}, target)
    edges = spark.read.parquet(f"{target}/edges")
    sinks.tables({"figures": edges.groupBy("rel").agg(F.count("*").alias("n"))}, target)
    return readers.tables(spark, target)
