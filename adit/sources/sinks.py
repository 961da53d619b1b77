"""Writers. Each writes one table with one action and can be run again with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.functions.identifiers import record_year


def documents(df: DataFrame, path: str, id_col: str = "id") -> None:
    """Documents by year of their id: YYYY, 'unknown' without an id, 'other' for years that aren't four digits. Only the years in df are replaced."""
    year = record_year(F.col(id_col))
    part = F.when(F.col(id_col).isNull() | (F.col(id_col) == ""), "unknown").when(year.rlike(r"^\d{4}$"), year).otherwise("other")
    out = df.withColumn("year", part)
    out.repartition("year", F.pmod(F.xxhash64(id_col), F.lit(32))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def tables(parts: dict[str, DataFrame], root: str) -> None:
    """One folder per table: nodes, edges, features, indexes, vectors."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def summary(df: DataFrame, path: str) -> None:
    """A row of figures, or few of them, as JSON in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def examples(df: DataFrame, path: str) -> None:
    """Training examples as JSON lines."""
    df.select("instruction", "input", "output").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def merged(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The upsert of new into old: the last row of each key by `order`; equal order keeps the new one."""
    rest = [c for c in old.columns if c != key]
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "__n")).alias("r")).select(key, "r.*")
