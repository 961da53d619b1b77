"""Filling containers of fixed capacity with items, none divided unless it is larger than a container.

Sizes are whole numbers up to the capacity, so that a histogram of them says all there is to plan. The plan is made from
it: large sizes are rounded up to the largest of their group, of few groups with equally many items each; a linear
programme over configurations of those few sizes, solved by column generation, says how often each configuration is
used; the actual sizes take the places; what that leaves, and the small sizes, go where they fit best. A plan is a list
of runs: the items of one size with ranks in a range go to containers that follow each other. Items get their ranks in
parallel, by buckets within their size, and find their run by binary search.

Rounded sizes fill a configuration exactly. Where small sizes fill what rounding leaves, few groups are best, else many.
So the grouping is made for a few shares of large sizes and numbers of groups, and the plan of the fewest containers is
taken.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sizes above this share of the capacity are large; large sizes are rounded in so many groups.
LARGE = (1 / 8, 1 / 5, 3 / 10)
GROUPS = (8, 12, 16, 64)
#: A size's items are ranked in buckets of about so many, so that no task sorts more, whatever share of all items a size has.
BUCKET_ITEMS = 200_000


@dataclass
class Run:
    """Items of a size with ranks low <= r < high go to container + (r - low) // each."""

    size: int
    low: int
    high: int
    container: int
    each: int


def _configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 1000) -> list[tuple[np.ndarray, float]]:
    """Basis of the cutting-stock programme and how often each configuration is used (fractional)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    use = counts / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        # The configuration of the greatest price: a knapsack over the capacity, size by size.
        best = np.zeros(capacity + 1)
        many = np.zeros((k, capacity + 1), np.int64)
        for j, size in enumerate(sizes):
            before = best.copy()
            for m in range(1, capacity // size + 1):
                value = before[: capacity + 1 - m * size] + m * price[j]
                better = value > best[m * size :] + 1e-12
                best[m * size :][better] = value[better]
                many[j, m * size :][better] = m
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        for j in range(k - 1, -1, -1):
            column[j] = many[j, c]
            c -= many[j, c] * sizes[j]
        direction = np.linalg.solve(basis, column)
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        use = use - step * direction
        use[out] = step
        basis[:, out] = column
    return [(basis[:, j].astype(int), max(0.0, float(use[j]))) for j in range(k)]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS[0], large: float = LARGE[1]) -> tuple[list[Run], int]:
    """Runs for all items of the histogram (size -> number of items), and the number of containers."""
    left = {s: int(n) for s, n in histogram.items() if n > 0}
    taken: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    containers = 0
    # Containers of equal room follow each other: room -> list of (first, number).
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def offer(room: int, first: int, number: int) -> None:
        if number and room:
            if not free[room]:
                bisect.insort(rooms, room)
            free[room].append((first, number))

    def place(size: int, number: int, first: int, each: int) -> None:
        runs.append(Run(size, taken[size], taken[size] + number, first, each))
        taken[size] += number
        left[size] -= number

    if left.get(capacity):
        n = left[capacity]
        place(capacity, n, 0, 1)
        containers = n
    big = sorted((s for s in left if s > capacity * large and left[s] > 0), reverse=True)
    total = sum(left[s] for s in big)
    if total:
        # Groups of equally many items, the largest sizes first; each is rounded up to its largest.
        order, goal = [(s, left[s]) for s in big], max(1, -(-total // groups))
        group, member = [], []
        room_left = 0
        for s, n in order:
            while n:
                if not room_left:
                    group.append([s, 0])
                    member.append([])
                    room_left = goal
                m = min(n, room_left)
                group[-1][1] += m
                member[-1].append([s, m])
                n, room_left = n - m, room_left - m
        # One size may fill several groups; for the programme they are one.
        merged: list[list[int]] = []
        pool: list[list[list[int]]] = []
        for (s, n), mem in zip(group, member):
            if merged and merged[-1][0] == s:
                merged[-1][1] += n
                pool[-1] += mem
            else:
                merged.append([s, n])
                pool.append(list(mem))
        sizes, counts = np.array([g[0] for g in merged]), np.array([g[1] for g in merged], float)
        for column, use in _configurations(sizes, counts, capacity):
            times = int(use + 1e-9)
            if not times or not column.any():
                continue
            # Each place of the configuration is taken by the next items of its group, largest first; loads change only where sizes do.
            changes: dict[int, int] = defaultdict(int)
            for g, many in enumerate(column):
                for _ in range(many):
                    at, last = 0, 0
                    while at < times and pool[g]:
                        s, n = pool[g][0]
                        m = min(n, times - at)
                        place(s, m, containers + at, 1)
                        changes[at] += s - last
                        last = s
                        at += m
                        pool[g][0][1] -= m
                        if not pool[g][0][1]:
                            pool[g].pop(0)
                    if at < times:
                        changes[at] -= last
            points, load = sorted(changes), 0
            for i, at in enumerate(points):
                load += changes[at]
                until = points[i + 1] if i + 1 < len(points) else times
                if until > at:
                    offer(capacity - load, containers + at, until - at)
            containers += times

    # What the programme left, and then the small sizes: the fullest containers that still have room come first.
    for size in sorted((s for s in left if left[s] > 0), reverse=True):
        while left[size]:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                number = -(-left[size] // each)
                offer(capacity, containers, number)
                containers += number
                continue
            room = rooms[i]
            first, number = free[room].pop()
            if not free[room]:
                rooms.pop(i)
            each = room // size
            full = min(number, left[size] // each)
            if full:
                place(size, full * each, first, each)
                offer(room - each * size, first, full)
            if full < number and left[size]:
                rest = left[size]
                place(size, rest, first + full, rest)
                offer(room - rest * size, first + full, 1)
                offer(room, first + full + 1, number - full - 1)
            elif full < number:
                offer(room, first + full, number - full)
    return runs, containers


def best_plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int, float, int]:
    """The plan of the fewest containers: its runs, containers, share of large sizes and number of groups."""
    plans = ((*plan(histogram, capacity, groups, large), large, groups) for large in LARGE for groups in GROUPS)
    return min(plans, key=lambda p: p[1])


def pack(sizes: DataFrame, key_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """container_id, key_col, part_no, token_from, token_to, n_tokens: one row per item, or per part of a larger one.

    Items above the capacity are cut into parts of the capacity and a rest; parts count from 0 and follow each other.
    Items of null, zero or negative size have no rows. Equal keys are items of their own. Other columns are ignored.
    sizes is read three times: give it stored, not computed.
    """
    items = (
        sizes.filter(F.col(size_col) > 0)
        .select(F.col(f"`{key_col}`").alias("key"), F.col(size_col).cast("bigint").alias("n"))
        .select("key", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("part_no"))
        .select("key", "part_no", F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("part_no").cast("bigint") * capacity).cast("int").alias("size"))
    )
    # At most `capacity` rows come to the driver, and the plan that is made of them has a few runs for each size and room.
    histogram = {r[0]: r[1] for r in items.groupBy("size").count().collect()}
    runs, *_ = best_plan(histogram, capacity)
    spark = sizes.sparkSession
    buckets = spark.createDataFrame([(s, -(-n // BUCKET_ITEMS)) for s, n in histogram.items()], "size int, buckets int")
    spread = items.join(F.broadcast(buckets), "size").withColumn("bucket", F.pmod(F.xxhash64("key", "part_no"), F.col("buckets")).cast("int"))
    counts = spread.groupBy("size", "bucket").agg(F.count("*").alias("c"))
    offsets = counts.select("size", "bucket", (F.sum("c").over(Window.partitionBy("size").orderBy("bucket")) - F.col("c")).alias("start"))
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("key", "part_no")) - 1)
    ranked = ranked.join(offsets, ["size", "bucket"]).select("key", "part_no", "size", (F.col("r") + F.col("start")).alias("rank"))

    runs.sort(key=lambda r: (r.size, r.low))
    columns = [np.array([getattr(r, c) for r in runs], np.int64) for c in ("size", "low", "container", "each")]
    span = max(histogram.values(), default=0) + 1
    shared = spark.sparkContext.broadcast((columns[0] * span + columns[1], *columns[1:]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, low, container, each = shared.value
        for batch in batches:
            rank = batch.column(3).to_numpy()
            run = np.searchsorted(starts, batch.column(2).to_numpy().astype(np.int64) * span + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(container[run] + (rank - low[run]) // each[run]), *batch.columns[:3]], ["container_id", "key", "part_no", "size"])

    placed = ranked.mapInArrow(place, f"container_id bigint, key {ranked.schema['key'].dataType.simpleString()}, part_no int, size int")
    begin = F.col("part_no").cast("bigint") * capacity
    return placed.select(
        "container_id",
        F.col("key").alias(key_col),
        "part_no",
        begin.alias("token_from"),
        (begin + F.col("size")).alias("token_to"),
        F.col("size").cast("bigint").alias("n_tokens"),
    )
