"""References to records that don't exist: orphan rows, and orphan counts per table and period.

References are aggregated per key and month before anything meets, and so are the births and deaths of targets. The
number of a key's target rows that are alive at the start of a month is a running sum over its months, so that a month
without births and deaths is settled for all of its references at once. Months with some are looked at by the minute,
and minutes with some by the instant; a key has at most 44,640 minutes in a month, so that no step gathers an unbounded
group, whatever key is hot on either side. Few undecided references (counted) are looked at by the instant at once. No
list of lifetimes is ever made.

Rows then meet the settled cells. Where the orphan cells are few (counted), they are broadcast. Else the heavy cells,
of which there are fewer than `heavy_cells`, are broadcast, and an anti-join leaves the other rows to a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.runtime import cut, small_enough

MONTH = "yyyy-MM"
#: So many cells (a field, a key, a period and a verdict: about 100 bytes) may be sent to every executor, once counted.
MOST_CELLS = 200_000
_KEY = ["ref_field", "key"]


@dataclass(frozen=True)
class Target:
    """A referenced table: the column of the references, the target's rows and how both write a key in one form."""

    ref_field: str
    rows: DataFrame
    key_col: str
    canonical: callable
    created_col: str = "created_at"
    deleted_col: str = "deleted_at"


def number_key(c: Column) -> Column:
    """Identifiers that are equal when their numbers are; those without digits stay as they are, trimmed and lowered."""
    digits = F.regexp_extract(c, r"(\d+)\D*$", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", "")).otherwise(F.lower(F.trim(c)))


def name_key(c: Column) -> Column:
    """Names that are equal but for letter case, outer blanks and blanks for underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), r"[ \u00a0]", "_")


def _month(at: Column) -> Column:
    return F.trunc(F.to_date(at), "month")


#: References of undecided months up to this number, once counted, are looked at by the instant at once, as no group has more.
FEW_ROWS = 1_000_000
_PERIOD = {"month": _month, "minute": lambda at: F.date_trunc("minute", at), "instant": lambda at: at}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def changes(targets: list[Target]) -> DataFrame:
    """What happens to the targets: ref_field, key, at, delta (rows that begin to live less rows that end), n_rows,
    first_created (the key's earliest creation so far as this row tells), undated (rows that were never created).

    A life is [created, deleted); rows that were never alive count as rows of their key only. Repeats collapse where
    they are. Rows with a null key don't exist.
    """
    parts = []
    for t in targets:
        rows = t.rows.select(
            F.lit(t.ref_field).alias("ref_field"), t.canonical(F.col(t.key_col)).alias("key"), F.col(t.created_col).alias("c"), F.col(t.deleted_col).alias("d")
        ).filter(F.col("key").isNotNull())
        alive = F.col("c").isNotNull() & (F.col("d").isNull() | (F.col("d") > F.col("c")))
        n = lambda x: F.lit(x).cast("bigint")
        both = F.array(
            F.struct(F.coalesce("c", "d").alias("at"), F.when(alive, n(1)).otherwise(n(0)).alias("delta"), n(1).alias("n_rows"), F.col("c").alias("first_created"), F.when(F.col("c").isNull(), n(1)).otherwise(n(0)).alias("undated")),
            F.struct(F.when(alive, F.col("d")).alias("at"), F.when(alive & F.col("d").isNotNull(), n(-1)).otherwise(n(0)).alias("delta"), n(0).alias("n_rows"), F.lit(None).cast(rows.schema["c"].dataType).alias("first_created"), n(0).alias("undated")),
        )
        parts.append(rows.select("ref_field", "key", F.inline(both)).filter("n_rows > 0 OR delta <> 0"))
    return _union(parts)


def references(edges: DataFrame, targets: list[Target], id_col: str, time_col: str) -> DataFrame:
    """One row per non-blank reference: id, ref_field, key, at, month (as a date)."""
    cells = [F.struct(F.lit(t.ref_field).alias("ref_field"), F.when(~F.col(t.ref_field).rlike(r"^[\s\u00a0]*$"), t.canonical(F.col(t.ref_field))).alias("key")) for t in targets]
    return (
        edges.select(F.col(id_col).alias("id"), F.col(time_col).alias("at"), _month(F.col(time_col)).alias("month"), *[t.ref_field for t in targets])
        .select("id", "at", "month", F.inline(F.array(*cells)))
        .filter(F.col("key").isNotNull())
    )


def _settled(cells: DataFrame, happened: DataFrame, group: list[str], period: str) -> DataFrame:
    """The verdict on each cell of references: group, period, n, verdict and what the next finer step needs.

    cells: group, period, n, lo, hi (span of the times). happened: group, period, net, e_lo, e_hi (births less deaths and
    their span), and, in the row of a null period, base and the key's facts.
    """
    none = lambda kind: F.lit(None).cast(kind)
    time = cells.schema["lo"].dataType
    a = cells.select(*group, period, "n", "lo", "hi", none("bigint").alias("net"), none(time).alias("e_lo"), none(time).alias("e_hi"), none("bigint").alias("base"), none("bigint").alias("n_rows"), none(time).alias("first_created"), none("bigint").alias("undated"))
    b = happened.select(*group, period, none("bigint").alias("n"), none(time).alias("lo"), none(time).alias("hi"), "net", "e_lo", "e_hi", "base", "n_rows", "first_created", "undated")
    merged = a.unionByName(b).groupBy(*group, period).agg(
        *[F.sum(c).alias(c) for c in ("n", "net", "base", "n_rows", "undated")], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("e_lo").alias("e_lo"), F.max("e_hi").alias("e_hi"), F.min("first_created").alias("first_created")
    )
    whole, before = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(F.asc_nulls_first(period)).rowsBetween(Window.unboundedPreceding, -1)
    known = merged.select(
        *group, period, "n", "lo", "hi", "net", "e_lo", "e_hi",
        (F.coalesce(F.sum("base").over(whole), F.lit(0)) + F.coalesce(F.sum("net").over(before), F.lit(0))).alias("base"),
        F.coalesce(F.sum("n_rows").over(whole), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("undated").over(whole), F.lit(0)).alias("undated"), F.min("first_created").over(whole).alias("first_created"),
    ).filter("n IS NOT NULL")
    c = F.col
    # Alive throughout the span of the references; null where a birth or death falls within it. A time equal to a birth's
    # is after it, one equal to a death's too.
    quiet = c("e_lo").isNull() | (c("hi") < c("e_lo"))
    past = c("lo") >= c("e_hi")
    alive = F.when(quiet, c("base") > 0).when(past, c("base") + c("net") > 0)
    dead = F.when((c("undated") > 0) | (c("first_created") <= c("lo")), "deleted").when(c("first_created") > c("hi"), "late").otherwise("mixed")
    verdict = F.when(c("n_rows") == 0, "missing").when(c("lo").isNull(), "live").when(alive, "live").when(~alive, dead).otherwise("mixed")
    return known.select(*group, period, "n", verdict.alias("verdict"), "base", "n_rows", "undated", "first_created")


def _steps(rows: DataFrame) -> list[tuple[str, str]]:
    """The finer steps for references of undecided months: the period that is divided, the period it is divided into."""
    return [("month", "instant")] if small_enough(rows, FEW_ROWS) else [("month", "minute"), ("minute", "instant")]


def _happened(events: DataFrame, group: list[str], period: str) -> DataFrame:
    moved = events.filter("delta <> 0").groupBy(*group, period).agg(F.sum("delta").alias("net"), F.min("at").alias("e_lo"), F.max("at").alias("e_hi"))
    return moved


def _with_facts(moved: DataFrame, facts: DataFrame, group: list[str], period: str) -> DataFrame:
    """The rows of _happened with one row of facts (base, n_rows, undated, first_created) per group, its period null."""
    return moved.unionByName(facts.withColumn(period, F.lit(None).cast(moved.schema[period].dataType)), allowMissingColumns=True)


def _months(refs: DataFrame, events: DataFrame) -> DataFrame:
    cells = refs.groupBy(*_KEY, "month").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    moved = _happened(events.withColumn("month", _month(F.col("at"))), _KEY, "month")
    facts = events.groupBy(*_KEY).agg(F.lit(0).cast("bigint").alias("base"), F.sum("n_rows").alias("n_rows"), F.sum("undated").alias("undated"), F.min("first_created").alias("first_created"))
    # References without a time have the null month, where the facts are too: nothing is alive or late there.
    return _settled(cells, _with_facts(moved, facts, _KEY, "month"), _KEY, "month")


def _finer(rows: DataFrame, events: DataFrame, open_cells: DataFrame, coarse: str, fine: str) -> DataFrame:
    """Verdicts on the finer cells of references `rows` that lie in undecided cells."""
    group = [*_KEY, coarse]
    side = open_cells.filter("verdict = 'mixed'").select(*group, "base", "n_rows", "undated", "first_created")
    inside = events.withColumn(coarse, _PERIOD[coarse](F.col("at"))).join(side.select(*group), group, "left_semi")
    moved = _happened(inside.withColumn(fine, _PERIOD[fine](F.col("at"))), group, fine)
    cells = rows.groupBy(*group, _PERIOD[fine](F.col("at")).alias(fine)).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    return _settled(cells, _with_facts(moved, side, group, fine), group, fine)


def _meet(refs: DataFrame, cells: DataFrame, on: list[str], wanted: str, heavy_cells: int) -> DataFrame:
    """refs with the verdict of their cell, where it is among `wanted` (a condition on verdict)."""
    side = cells.filter(wanted).select(*on, "verdict")
    if small_enough(side, MOST_CELLS):
        return refs.join(F.broadcast(side), on)
    # A cell is heavy when it holds more than 1 / heavy_cells of the references: there are fewer than heavy_cells such cells.
    total = cells.agg(F.sum("n")).first()[0]
    heavy = F.broadcast(cells.filter(F.col("n") * heavy_cells > F.lit(total)).select(*on, "verdict"))
    hot = refs.join(heavy, on).filter(wanted)
    rest = refs.join(heavy.drop("verdict"), on, "left_anti").join(side, on)
    return hot.unionByName(rest)


def orphans(edges: DataFrame, targets: list[Target], id_col: str = "edge_id", time_col: str = "loaded_at", heavy_cells: int = 2000) -> DataFrame:
    """Every reference without a live target: id_col, ref_field, reason, load_month.

    reason is 'missing' (no row has the key), 'late' (all rows were created after the reference) or 'deleted'. Null and
    blank references aren't references. A reference without a time is an orphan only if its key is missing; its month is
    null. A target row without a creation was never alive, but its key is neither missing nor late. Repeated edges each
    count. Columns other than those named are ignored. Empty edges give no rows; an empty target makes every reference
    to it 'missing'.
    """
    refs, events = references(edges, targets, id_col, time_col), cut(changes(targets), "changes")
    months = cut(_months(refs, events), "months")
    # Cells of a null month are only looked up to be settled as missing or live; they meet by the date of no month.
    none = F.lit("0001-01-01").cast("date")
    filled = months.withColumn("month", F.coalesce("month", none))
    met = cut(_meet(refs.withColumn("month", F.coalesce("month", none)), filled, [*_KEY, "month"], "verdict <> 'live'", heavy_cells), "met")
    out, cells, rows = [met.filter("verdict <> 'mixed'")], months, met.filter("verdict = 'mixed'").drop("verdict")
    for coarse, fine in [] if rows.isEmpty() else _steps(rows):
        cells = cut(_finer(rows, events, cells, coarse, fine), fine)
        met = _meet(rows.withColumn(fine, _PERIOD[fine](F.col("at"))), cells, [*_KEY, fine], "verdict <> 'live'", heavy_cells)
        # At the instant nothing is undecided any more.
        met = met if fine == "instant" else cut(met, "met")
        out.append(met.filter("verdict <> 'mixed'").select(*out[0].columns))
        rows = met.filter("verdict = 'mixed'").drop("verdict")
    return _union(out).select(F.col("id").alias(id_col), "ref_field", F.col("verdict").alias("reason"), F.date_format("at", MONTH).alias("load_month"))


def orphan_counts(edges: DataFrame, targets: list[Target], id_col: str = "edge_id", time_col: str = "loaded_at", heavy_cells: int = 2000) -> DataFrame:
    """Orphans per referenced table and month: ref_field, load_month, n_missing, n_late, n_deleted, n_refs.

    Counts come from the cells, and rows are looked at again only in months that births and deaths divide. A month's
    n_refs counts all of its references to the table, orphans or not.
    """
    refs, events = references(edges, targets, id_col, time_col), cut(changes(targets), "changes")
    cells = cut(_months(refs, events), "months")
    settled = [cells.select("ref_field", "month", "verdict", "n")]
    if not cells.filter("verdict = 'mixed'").isEmpty():
        rows = cut(_meet(refs, cells, [*_KEY, "month"], "verdict = 'mixed'", heavy_cells).drop("verdict"), "open")
        steps = _steps(rows)
        for coarse, fine in steps:
            if coarse != "month":
                rows = _meet(rows, cells, [*_KEY, coarse], "verdict = 'mixed'", heavy_cells).drop("verdict")
            cells = _finer(rows, events, cells, coarse, fine)
            cells = cells if fine == "instant" else cut(cells, fine)
            settled.append(cells.select("ref_field", _month(F.col(fine)).alias("month"), "verdict", "n"))
            rows = rows.withColumn(fine, _PERIOD[fine](F.col("at")))
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("verdict") == kind, F.col("n"))), F.lit(0))
    # Every reference is in one settled cell: mixed cells are counted by their finer ones.
    sums = _union(settled).filter("verdict <> 'mixed'").groupBy("ref_field", F.date_format("month", MONTH).alias("load_month"))
    return sums.agg(n("missing").alias("n_missing"), n("late").alias("n_late"), n("deleted").alias("n_deleted"), F.sum("n").alias("n_refs"))
