"""Vectors: similarity, exact search, means, inference by likeness, hashed text vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.functions.texts import words

#: Vectors of one block.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    return F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    """Cosine; a length of 0 counts as `floor`."""
    length = lambda c: F.when(norm(c) == 0, floor).otherwise(norm(c))
    return dot(a, b) / (length(a) * length(b))


def search(vectors: DataFrame, query: list[float], k: int, most: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest vectors: id, cosine, distance (squared) and score (1 - distance), as for vectors of length 1.

    The query is a constant of the plan; each partition keeps its k best. Ranks are of the exact cosine, ties by id;
    figures are rounded. Null vectors aren't found.
    """
    return rounded(scored(vectors, query, vec_col).orderBy(F.desc("cosine"), id_col).limit(min(k, most)), vec_col)


def scored(vectors: DataFrame, query: list[float], vec_col: str = "embedding") -> DataFrame:
    """vectors with the exact `cosine` to a query, both of length 1."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.filter(F.col(vec_col).isNotNull()).withColumn("cosine", dot(F.col(vec_col), q))


def rounded(found: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """The figures of what was found, rounded, without the vectors."""
    c = F.round("cosine", 6)
    return found.withColumns({"cosine": c, "distance": F.round(2 - 2 * c, 6), "score": F.round(2 * c - 1, 6)}).drop(vec_col)


def _blocks(df: DataFrame, id_col: str, vec_col: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows in blocks of about `size`: the number of the block, ids and vectors; and how many blocks there are."""
    rows = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(vec_col).alias("v")).filter("v IS NOT NULL")
    n = max(1, -(-rows.count() // size))
    # Equal rows are spread too: the number of a row in its partition is part of the hash.
    numbered = rows.withColumn("b", F.pmod(F.xxhash64("i", F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return numbered.groupBy(F.col("b").alias(name)).agg(F.collect_list(F.struct("i", "v")).alias(f"{name}_rows")), n


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query vector, its k nearest others: query_id, id, cosine, rank; exact, for vectors of length 1.

    Queries and vectors are put into blocks of a bounded size, and every block of the one meets every block of the
    other: a matrix product gives all cosines of two blocks and keeps k for each query, so that only those are ranked.
    Nothing goes through the driver, and more queries mean more tasks. Rows of the query's own id are left out.
    """
    q, _ = _blocks(queries, id_col, vec_col, BLOCK, "q")
    v, _ = _blocks(vectors, id_col, vec_col, BLOCK, "v")
    n = queries.count()
    numbers = F.sequence(F.lit(0), F.lit(max(1, -(-n // BLOCK)) - 1))
    met = v.select("v", "v_rows", F.explode(numbers).alias("q")).join(q, "q")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sides = []
                for c in ("q_rows", "v_rows"):
                    rows = batch.column(batch.schema.get_field_index(c)).slice(r, 1).flatten()
                    vecs = rows.field("v")
                    sides.append((rows.field("i").to_numpy(), vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), -1)))
                (qi, qv), (vi, vv) = sides
                c = qv @ vv.T
                c[qi[:, None] == vi[None, :]] = -9
                m = min(k, len(vi))
                # By cosine, ties by id.
                order = np.lexsort((np.broadcast_to(vi, c.shape), -c), axis=1)[:, :m]
                rows, cols = np.repeat(np.arange(len(qi)), m), order.ravel()
                keep = c[rows, cols] > -9
                yield pa.RecordBatch.from_arrays([pa.array(qi[rows][keep]), pa.array(vi[cols][keep]), pa.array(c[rows, cols][keep])], ["query_id", id_col, "cosine"])

    found = met.mapInArrow(scan, f"query_id bigint, `{id_col}` bigint, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("cosine", F.round("cosine", 6))


def mean(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """The mean vector as one row `mean`: positions are averaged where the rows are."""
    parts = vectors.select(F.posexplode(vec_col).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def inferred(vectors: DataFrame, observed: Column, threshold: float, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k vectors most like the mean of the observed ones, above the threshold and not observed: id, confidence."""
    seen = vectors.filter(observed)
    m = mean(seen, vec_col).first()[0]
    if not m:
        return vectors.select(id_col, F.lit(0.0).alias("confidence")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in m])
    rest = vectors.filter(~observed).withColumn("confidence", cosine(F.col(vec_col), q))
    best = rest.filter(F.col("confidence") > threshold).select(id_col, "confidence").orderBy(F.desc("confidence"), id_col).limit(k)
    return best.withColumn("confidence", F.round("confidence", 6))


def hashed_text(df: DataFrame, text_col: str, size: int = 64, out_col: str = "embedding") -> DataFrame:
    """Texts as vectors of length 1 without a model: counts of hashed words. A text without words is the zero vector."""
    hits = F.transform(words(F.lower(F.coalesce(text_col, F.lit("")))), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))

    @F.pandas_udf("array<float>")
    def counted(places: pd.Series) -> pd.Series:
        out = []
        for p in places:
            v = np.bincount(np.asarray(p, np.int64), minlength=size).astype(np.float64)
            length = np.sqrt(v @ v)
            out.append((v / length if length else v).astype(np.float32))
        return pd.Series(out)

    # Words are hashed in the JVM; only their places, counted on Arrow batches, leave it.
    return df.withColumn(out_col, counted(hits))
