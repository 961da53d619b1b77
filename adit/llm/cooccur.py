"""Items that appear together: exact pair counts, and how surprising they are under a fitted null.

Only pairs that can pass the support are counted, and none that can is lost: both items of a pair that holds in n_ab
records have at least n_ab records themselves. So rare items leave the baskets first; where a lift is asked for, so do
items too common to reach it. What is left of a basket is expanded into its pairs, which are counted with a partial
aggregation before the shuffle.

The null is the bipartite configuration model: item a is in a basket of size s with probability x_a y_s / (1 + x_a y_s),
with x and y fitted so that the expected item frequencies and basket sizes are the observed ones. A pair's count is then
Poisson-binomial; its upper tail comes from the saddlepoint of its cumulants, and Benjamini-Hochberg controls the rate
of false discoveries among all pairs tested.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.runtime import cut, small_enough

FIELDS = ("cwe_refs", "mitre_techniques", "affected_vendors")
#: Item frequencies are fitted by class; the frequencies of a class lie within this ratio of each other.
CLASS_RATIO = 1.01


def latest_baskets(df: DataFrame, key_col: str = "cve_id", order_cols: tuple[str, ...] = ("last_modified_at", "ingest_id"), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One basket per key and field: basket, field_name, items (distinct, sorted, not empty).

    A key is represented by its row with the greatest order_cols; nulls there come first. Rows with a null key are no
    records. Null elements are no items; an empty string is one.
    """
    newest = df.filter(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("basket")).agg(
        F.max_by(F.struct(*[F.col(f) for f in fields]), F.struct(*order_cols)).alias("r")
    )
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.array_sort(F.array_distinct(F.array_compact(F.col(f"r.{f}")))).alias("items")) for f in fields])
    return newest.select("basket", F.inline(cells)).filter(F.size("items") > 0)


def item_counts(baskets: DataFrame) -> DataFrame:
    return baskets.select("field_name", F.explode("items").alias("item")).groupBy("field_name", "item").agg(F.count("*").alias("n"))


def frequent_items(baskets: DataFrame, min_count: int = 3, min_share: float = 0.001) -> DataFrame:
    """field_name, item, n, n_records of the items that have the support, stored.

    Every item has a min_share of the records, so a field has at most (mean basket size) / min_share of them.
    """
    totals = baskets.groupBy("field_name").agg(F.count("*").alias("n_records"))
    items = item_counts(baskets).join(F.broadcast(totals), "field_name")
    return cut(items.filter((F.col("n") >= min_count) & _has_share("n", min_share)), "items")


def _has_share(n: str, min_share: float) -> Column:
    """Shares are compared in whole numbers: n * (1 / min_share) >= n_records."""
    return F.col(n) * F.lit(round(1 / min_share)) >= F.col("n_records") if min_share else F.lit(True)


def pair_counts(baskets: DataFrame, min_count: int = 3, min_share: float = 0.001, min_lift: float = 0.0, frequent: DataFrame | None = None) -> DataFrame:
    """field_name, item_a, item_b (item_a < item_b by code point), n_ab, n_a, n_b, n_records of all pairs with
    n_ab >= min_count, n_ab >= min_share * n_records and n_ab * n_records >= min_lift * n_a * n_b.

    frequent: the frequent_items, if they are at hand. A count lets them be broadcast.
    """
    frequent = frequent_items(baskets, min_count, min_share) if frequent is None else frequent
    if min_lift:  # n_ab <= min(n_a, n_b), so the greater of the two has at most n_records / min_lift
        frequent = frequent.filter(F.col("n") * min_lift <= F.col("n_records"))
    few = small_enough(frequent)
    side = F.broadcast(frequent) if few else frequent
    # The items' numbers replace their names in the shuffles; their order is the items'.
    ranked = frequent.select("field_name", "item")
    kept = baskets.select("basket", "field_name", F.explode("items").alias("item")).join(F.broadcast(ranked) if few else ranked, ["field_name", "item"], "left_semi")
    rest = kept.groupBy("basket", "field_name").agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items") > 1)
    pairs = F.flatten(F.transform("items", lambda a, i: F.transform(F.slice(F.col("items"), i + 2, F.size("items")), lambda b: F.struct(a.alias("item_a"), b.alias("item_b")))))
    counted = rest.select("field_name", F.inline(pairs)).groupBy("field_name", "item_a", "item_b").agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    a = side.select("field_name", F.col("item").alias("item_a"), F.col("n").alias("n_a"), "n_records")
    b = side.select("field_name", F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    if few:
        a, b = F.broadcast(a), F.broadcast(b)
    out = counted.join(a, ["field_name", "item_a"]).join(b, ["field_name", "item_b"])
    out = out.filter(_has_share("n_ab", min_share))
    if min_lift:
        out = out.filter(F.col("n_ab") * F.col("n_records") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    return out.select("field_name", "item_a", "item_b", "n_ab", "n_a", "n_b", "n_records")


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log(counts) / np.log(CLASS_RATIO)).astype(np.int64)


#: What stands for the infinite parameter of an item in every basket or a basket with every item, and for the one of what has nothing but these.
SURE, NONE = 1e20, 1e-10


def fit_null(degrees: np.ndarray, degree_counts: np.ndarray, sizes: np.ndarray, size_counts: np.ndarray, rounds: int = 20_000, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """x by item degree and y by basket size, from the numbers of items and baskets with each; a fixed-point iteration.

    It ends when every expected degree and size is within `tolerance` of the observed one. Items in every basket and
    baskets with every item are sure; they are taken out first, until none is left, as their parameters are infinite.
    Margins whose fit is still further than 1e-3 from them after all rounds raise a ValueError.
    """
    d, s = degrees.astype(float).copy(), sizes.astype(float).copy()
    x, y = np.full(len(d), NONE), np.full(len(s), NONE)
    items, baskets = np.ones(len(d), bool), np.ones(len(s), bool)
    while True:
        full = items & (d >= size_counts[baskets].sum() - 1e-9) & (d > 0)
        if full.any():
            x[full], items[full] = SURE, False
            s[baskets] -= degree_counts[full].sum()
        whole = baskets & (s >= degree_counts[items].sum() - 1e-9) & (s > 0)
        if whole.any():
            y[whole], baskets[whole] = SURE, False
            d[items] -= size_counts[whole].sum()
        items &= d > 1e-9
        baskets &= s > 1e-9
        if not (full.any() or whole.any()):
            break
    if not items.any() or not baskets.any():
        return x, y
    d, s, dc, sc = d[items], s[baskets], degree_counts[items], size_counts[baskets]
    total = float((d * dc).sum())
    u, v = d / np.sqrt(total), s / np.sqrt(total)
    far = np.inf
    for _ in range(rounds):
        u_new = d / (sc * (v / (1 + np.outer(u, v)))).sum(axis=1)
        v_new = s / (dc[:, None] * (u_new[:, None] / (1 + np.outer(u_new, v)))).sum(axis=0)
        # A parameter's step is the ratio of the observed to the expected margin.
        far = max(np.abs(u_new / u - 1).max(), np.abs(v_new / v - 1).max())
        u, v = u_new, v_new
        if far < tolerance:
            break
    if far > 1e-3:
        raise ValueError(f"the null doesn't fit the frequencies: a margin is off by {far:.1e} after {rounds} rounds")
    x[items], y[baskets] = u, v
    return x, y


def upper_tail(n: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected value, and P(X >= n), of X = the sum of Binomial(m[s], q[:, s]), row by row; Lugannani-Rice for lattices."""
    n = n.astype(float)
    mean = q @ m
    var = (q * (1 - q)) @ m
    top = ((q > 0) * m).sum(axis=1)
    p = np.ones(len(n))
    inner = (n > mean + 1e-9) & (n < top)
    edge = (n >= top) & (n > mean + 1e-9)
    with np.errstate(divide="ignore"):
        p[edge] = np.exp((np.log(q[edge], where=q[edge] > 0, out=np.zeros_like(q[edge]))) @ m) if edge.any() else 1.0
    i = np.flatnonzero(inner)
    if len(i):
        qi, ni, t = q[i], n[i], np.zeros(len(i))
        low, high = np.zeros(len(i)), np.full(len(i), 50.0)
        for _ in range(80):  # K' grows, so halving always ends; a Newton step is taken where it stays inside
            e = qi * np.exp(t)[:, None]
            w = e / (1 - qi + e)
            k1, k2 = w @ m, (w * (1 - w)) @ m
            low, high = np.where(k1 < ni, t, low), np.where(k1 < ni, high, t)
            step = t - (k1 - ni) / np.maximum(k2, 1e-300)
            new = np.where((step > low) & (step < high), step, (low + high) / 2)
            if np.abs(new - t).max() < 1e-12:
                break
            t = new
        e = qi * np.exp(t)[:, None]
        k = np.log1p(qi * np.expm1(t)[:, None]) @ m
        w = e / (1 - qi + e)
        k2 = (w * (1 - w)) @ m
        r = np.sqrt(np.maximum(2 * (t * ni - k), 1e-300))
        u = -np.expm1(-t) * np.sqrt(k2)
        log_phi = -r * r / 2 - np.log(np.sqrt(2 * np.pi))
        tail = np.array([0.5 * erfc(z / np.sqrt(2)) for z in r])
        p[i] = np.clip(np.where(r < 36, tail + np.exp(log_phi) * (1 / u - 1 / r), np.exp(log_phi) / u), 0, 1)
    low = (n <= mean + 1e-9) & (n > 0)
    z = (n[low] - 0.5 - mean[low]) / np.sqrt(np.maximum(var[low], 1e-300))
    p[low] = [0.5 * erfc(v / np.sqrt(2)) for v in z]
    return mean, p


def surprise(baskets: DataFrame, min_count: int = 3, min_share: float = 0.001) -> DataFrame:
    """The pairs of pair_counts with lift (count times records over the product of the items' counts), expected (under
    the null), p_value and q_value (false-discovery rate at which the pair would be reported, among all pairs of items
    that have the support). Empty baskets give no rows.
    """
    spark = baskets.sparkSession
    frequent = frequent_items(baskets, min_count, min_share)
    pairs = pair_counts(baskets, min_count, min_share, frequent=frequent)
    eligible = {r[0]: r[1] for r in frequent.groupBy("field_name").count().collect()}
    # Numbers of items by degree and of baskets by size. Degrees differ at most as the root of all elements; classes bound them further.
    degree = item_counts(baskets).groupBy("field_name", (F.floor(F.log(F.col("n").cast("double")) / float(np.log(CLASS_RATIO)))).alias("cls")).agg(F.count("*").alias("items"), F.sum("n").alias("n"))
    size = baskets.groupBy("field_name", (F.floor(F.log(F.size("items").cast("double")) / float(np.log(CLASS_RATIO)))).alias("cls")).agg(F.count("*").alias("m"), F.sum(F.size("items")).alias("n"))
    model: dict[str, tuple] = {}
    rows = {"d": degree.collect(), "s": size.collect()}
    for f in sorted({r.field_name for r in rows["d"]}):
        d = sorted((r.cls, r.n / r.items, r.items) for r in rows["d"] if r.field_name == f)
        s = sorted((r.cls, r.n / r.m, r.m) for r in rows["s"] if r.field_name == f)
        dv, dc, sv, sc = (np.array(v, float) for v in ([x[1] for x in d], [x[2] for x in d], [x[1] for x in s], [x[2] for x in s]))
        x, y = fit_null(dv, dc, sv, sc)
        n = eligible.get(f, 0)
        model[f] = (np.log(dv), np.log(x), y, sc, max(1.0, n * (n - 1) / 2))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = np.array(batch.column(0).to_pylist(), object)
            n_ab, n_a, n_b = (batch.column(k).to_numpy() for k in (3, 4, 5))
            mean, p, tests = np.zeros(len(fields)), np.ones(len(fields)), np.ones(len(fields))
            for f in set(fields):
                at = np.flatnonzero(fields == f)
                logs, x, y, m, many = model[f]
                for part in np.array_split(at, max(1, len(at) // 2000)):
                    xa, xb = (np.exp(np.interp(np.log(v[part]), logs, x)) for v in (n_a, n_b))
                    q = (xa[:, None] * y / (1 + xa[:, None] * y)) * (xb[:, None] * y / (1 + xb[:, None] * y))
                    mean[part], p[part] = upper_tail(n_ab[part], q, m)
                tests[at] = many
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean), pa.array(p), pa.array(tests)], [*batch.schema.names, "expected", "p_value", "tests"])

    tested = cut(pairs.mapInArrow(test, "field_name string, item_a string, item_b string, n_ab bigint, n_a bigint, n_b bigint, n_records bigint, expected double, p_value double, tests double"), "tested")
    ranked = _false_discovery(tested)
    lift = F.col("n_ab") * F.col("n_records") / (F.col("n_a") * F.col("n_b"))
    return ranked.select("field_name", "item_a", "item_b", "n_ab", "n_a", "n_b", "n_records", lift.alias("lift"), "expected", "p_value", "q_value")


def _false_discovery(tested: DataFrame) -> DataFrame:
    """Benjamini-Hochberg within each field without sorting a field in one task: ranks come from the counts of slices of p.

    A field's pairs are bounded by the square of its frequent items, whatever the number of baskets.
    """
    slice_of: Column = F.least(F.lit(16_000), F.floor(-F.log10(F.greatest("p_value", F.lit(1e-320))) * 50)).cast("int")
    t = tested.withColumn("slice", slice_of)
    counts = t.groupBy("field_name", "slice").agg(F.count("*").alias("c"), F.max("p_value").alias("most"))
    field = Window.partitionBy("field_name")
    before = counts.withColumn("before", F.sum("c").over(field.orderBy(F.desc("slice"))) - F.col("c"))
    # Slices hold falling p; a slice's last rank is before + c. What later slices allow bounds the earlier ones.
    bound = before.withColumn("later", F.min(F.col("most") / (F.col("before") + F.col("c"))).over(field.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    # The first slice, p near 1, has no use for ranks and may be most of the rows.
    joined = t.join(F.broadcast(bound.select("field_name", "slice", "before", "c", "later")), ["field_name", "slice"])
    inner = Window.partitionBy("field_name", "slice").orderBy("p_value")
    sharp = joined.filter("slice > 0").withColumn("ratio", F.col("p_value") / (F.col("before") + F.rank().over(inner) + F.count("*").over(Window.partitionBy("field_name", "slice", "p_value")) - 1))
    sharp = sharp.withColumn("best", F.least(F.min("ratio").over(Window.partitionBy("field_name", "slice").orderBy("p_value").rangeBetween(Window.currentRow, Window.unboundedFollowing)), "later"))
    blunt = joined.filter("slice = 0").withColumn("best", F.col("p_value") / (F.col("before") + F.col("c")))
    both = sharp.drop("ratio").unionByName(blunt)
    return both.withColumn("q_value", F.least(F.lit(1.0), F.col("best") * F.col("tests")))
