"""Joins, nesting and deduplication that the domain's pipelines are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.runtime import cut, small_enough


def product_key(vendor: str = "normalized_vendor", product: str = "normalized_product") -> Column:
    none = F.lit("")
    return F.concat(F.coalesce(F.col(vendor), none), F.lit(":"), F.coalesce(F.col(product), none))


def flagged(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """df with a flag that says whether its key is among `keys` (distinct); null keys are not.

    A few keys are broadcast once counted; more of them meet by shuffle.
    """
    marked = keys.withColumn(flag, F.lit(True))
    side = F.broadcast(marked) if small_enough(keys) else marked
    return df.join(side, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def looked_up(df: DataFrame, key: str, list_col: str, names: DataFrame, name_key: str, name_col: str) -> DataFrame:
    """For each key whose list has known elements: name_col, the sorted names of its different elements, and n.

    names has one row per name_key; elements without one are left out, and so are null elements.
    """
    items = df.select(key, F.explode(F.array_distinct(list_col)).alias(name_key))
    side = F.broadcast(names) if small_enough(names) else names
    found = items.join(side.select(name_key, name_col), name_key)
    return found.groupBy(key).agg(F.array_sort(F.collect_list(name_col)).alias(name_col), F.count("*").alias("n"))


def first_of_equals(df: DataFrame, value: str, order: str) -> DataFrame:
    """The least `order` and the number of rows of each different value; nulls are left out. Long values meet by their SHA-256."""
    t = df.filter(F.col(value).isNotNull()).select(F.unhex(F.sha2(F.col(value), 256)).alias("mark"), order)
    return t.groupBy("mark").agg(F.min(order).alias(order), F.count("*").alias("copies")).drop("mark")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by `order`, nulls first; rows with a null key are left out.

    An aggregation, partly done before the shuffle: a hot key is no burden, and no group is sorted.
    """
    rest = [c for c in df.columns if c != key]
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each partition's groups before it shuffles them."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def ranked_per_group(df: DataFrame, group: str, order: list[Column], n: int, rank: str) -> DataFrame:
    """The first n rows of each group with their place from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= n)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the number of each row in an order, from 0. The order should leave no ties.

    Rows are sorted by range and numbered within their partition; the partitions' sizes, one row each, give the offsets.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    marked = cut(df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", place), "numbered")
    sizes = marked.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__o"))
    return marked.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + F.col("__i")).drop("__p", "__i", "__o")


def inverted(df: DataFrame, key_col: str, id_col: str) -> DataFrame:
    """Distinct (key, id) rows of an index; exporters nest them."""
    return df.select(F.col(key_col).alias("key"), F.col(id_col).alias("id")).filter(F.col("key").isNotNull()).distinct()
