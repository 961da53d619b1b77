"""Queries on the problems of training data for language models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.llm.canon import canonical_names, map_names
from adit.llm.chunking import limits, split_oversized
from adit.llm.cooccur import latest_baskets, pair_counts, surprise
from adit.llm.encode import count_tokens, encode_corpus
from adit.llm.packing import pack
from adit.llm.pairs import defects
from adit.llm.sql import SQL as SQL
from adit.llm.unify import look_alikes, unified
from adit.runtime import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return defects(table(spark, d, "training_examples"))


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized text."""
    return split_oversized(table(spark, d, "cves"), "ingest_id", limits(table(spark, d, "size_limits")))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).filter("piece_no = 0").select("ingest_id", "field_name")


@query
def p5_surprise(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with the support, with their tails under the fitted null."""
    return surprise(cut(latest_baskets(table(spark, d, "cves")), "baskets"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The surprising pairs that are at least four times as frequent as by chance."""
    return p5_surprise(spark, d).filter(F.col("n_ab") * F.col("n_records") >= 4 * F.col("n_a") * F.col("n_b")).select("field_name", "item_a", "item_b")


@query
def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with the support, with their counts and ratio to chance."""
    baskets = cut(latest_baskets(table(spark, d, "cves")), "baskets")
    lift = F.round(F.col("n_ab") * F.col("n_records") / (F.col("n_a") * F.col("n_b")), 6)
    return pair_counts(baskets).select("field_name", "item_a", "item_b", "n_ab", "n_a", "n_b", "n_records", lift.alias("lift"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    names = canonical_names(table(spark, d, "vendor_nodes"))
    return map_names(table(spark, d, "cpe_components"), "component_id", ["vendor", "normalized_vendor"], names)


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


@query
def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers of the capacity that size_limits names."""
    capacity = next(x.max_size for x in limits(table(spark, d, "size_limits"), "tokens") if x.field_name == "documents.text")
    return pack(cut(count_tokens(table(spark, d, "documents")), "sizes"), capacity=capacity)


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alikes(table(spark, d, "documents"))


@query
def p10_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its one form."""
    return unified(table(spark, d, "documents")).select("doc_id", "unified_text")
