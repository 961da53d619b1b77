"""Streams of records: the latest state of each record kept by upserts, and counts by window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adit.operators.relations import latest


def read_records(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: The state is kept in so many parts, by the hash of the key; a batch rewrites only the parts that its keys touch.
PARTS = 64


def keep_latest(stream: DataFrame, target: str, checkpoint: str, key: str, order: list[str]) -> StreamingQuery:
    """Keep in `target` the last row of each key by `order`, whatever order the rows arrive in.

    The state lies in parts by the hash of the key. A batch writes new versions, named by its number, of the parts it
    touches; a reader takes the newest version of each part. Running a batch again gives the same files, as it starts
    from the versions of earlier batches. Versions that two later ones have replaced are deleted.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parted = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
        parted.persist()
        try:
            touched = [r[0] for r in parted.select("part").distinct().collect()]
            before = {p: v for p, v in versions(spark, target, number).items() if p in touched}
            rows = parted
            if before:
                old = spark.read.option("basePath", target).parquet(*[_path(target, p, v) for p, v in before.items()])
                rows = rows.unionByName(old.select(*parted.columns))
            new = latest(rows, key, order).withColumn("version", F.lit(number))
            new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(target)
            _drop_old(spark, target, touched, number)
        finally:
            parted.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start()


def _path(target: str, part: int, version: int) -> str:
    return f"{target}/part={part}/version={version}"


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}="))


def versions(spark: SparkSession, target: str, before: int = 1 << 62) -> dict[int, int]:
    """The newest version of each part, of those before a number."""
    found = {p: [v for v in _folders(spark, f"{target}/part={p}", "version") if v < before] for p in _folders(spark, target, "part")}
    return {p: max(v) for p, v in found.items() if v}


def _drop_old(spark: SparkSession, target: str, parts: list[int], number: int) -> None:
    """Of each part, keep this version and the two before it, so that a batch can run again and a reader can finish."""
    for p in parts:
        for v in [v for v in _folders(spark, f"{target}/part={p}", "version") if v < number][:-2]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_path(target, p, v))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def latest_state(spark: SparkSession, target: str) -> DataFrame:
    """The state that keep_latest has written last."""
    return spark.read.option("basePath", target).parquet(*[_path(target, p, v) for p, v in versions(spark, target).items()]).drop("part", "version")


def windowed_counts(stream: DataFrame, time_col: str = "ts", key: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Rows and their mean value by key and window; rows later than the watermark are left out, as in every such stream."""
    return (
        stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
        .withWatermark(time_col, late)
        .groupBy(F.window(time_col, size), key)
        .agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
        .select(F.col("window.start").alias("start"), key, "n", "mean")
    )
