"""Best-fit-decreasing packing.

Two forms of the same rule. `best_fit_decreasing` packs a list held by one task, bin by bin. `plan` packs
a whole table from its histogram of sizes: bins that are equal so far stand for one another, so it moves
whole classes of items into classes of bins and needs a few thousand steps at most whatever the number of
items; `pack` then deals the items of each size out to the planned places by rank. Both ask a segment
tree over remaining capacities for the tightest open bin, in logarithmic time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut


class Capacities:
    """Segment tree over remaining capacities 0..limit: marks those that some open bin has."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.marked = [False] * (2 * self.leaves)

    def mark(self, capacity: int, there: bool) -> None:
        i = capacity + self.leaves
        self.marked[i] = there
        while i > 1:
            i //= 2
            there = self.marked[2 * i] or self.marked[2 * i + 1]
            if self.marked[i] == there:
                break
            self.marked[i] = there

    def tightest(self, size: int) -> int | None:
        """The least marked capacity that is size or more."""
        i = size + self.leaves
        if not self.marked[i]:
            while i > 1 and (i % 2 or not self.marked[i + 1]):  # up, until a marked subtree lies to the right
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.marked[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(sizes: Iterable[int], limit: int) -> tuple[list[int], list[int], int]:
    """(bin of each item, offset of each item in it, number of bins). Sizes run from 1 to limit; ties keep their order."""
    sizes = list(sizes)
    tree = Capacities(limit)
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, n = [0] * len(sizes), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        capacity = tree.tightest(size)
        if capacity is None:
            at, n, capacity = n, n + 1, limit
        else:
            at = open_bins[capacity].pop()
            if not open_bins[capacity]:
                tree.mark(capacity, False)
        bins[i], offsets[i] = at, limit - capacity
        if rest := capacity - size:
            if not open_bins[rest]:
                tree.mark(rest, True)
            open_bins[rest].append(at)
    return bins, offsets, n


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of sizes: (size, first rank, number, first bin, offset), the places of the
    items of a size by their rank from 0. Items of one size are alike, and so are open bins of one capacity, so that a
    run of bins with numbers next to each other is filled at once; each bin takes equal items while they fit, as it
    would one by one, for a bin just filled is the tightest."""
    tree = Capacities(limit)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]  # by capacity: (first bin, number)
    places, n_bins = [], 0

    def put(capacity: int, first: int, number: int) -> None:
        if capacity and number:
            if not runs[capacity]:
                tree.mark(capacity, True)
            runs[capacity].append((first, number))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            capacity = tree.tightest(size)
            if capacity is None:
                capacity = limit
                first, number = n_bins, -(-left // (limit // size))
                n_bins += number
            else:
                first, number = runs[capacity].pop()
                if not runs[capacity]:
                    tree.mark(capacity, False)
            each = capacity // size
            full = min(number, left // each)
            for k in range(each):
                if full:
                    places.append((size, rank + k * full, full, first, limit - capacity + k * size))
            rank, left = rank + each * full, left - each * full
            put(capacity - each * size, first, full)
            if full < number:
                for k in range(left if left < each else 0):
                    places.append((size, rank + k, 1, first + full, limit - capacity + k * size))
                if 0 < left < each:
                    put(capacity - left * size, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(capacity, first + full, number - full)
    return places


def planned(spark: SparkSession, histogram: dict[int, int], limit: int) -> DataFrame:
    """The plan of a histogram as a table: _size, _first, _many, _bin, offset. Sizes outside 1..limit raise an error."""
    if bad := [s for s in histogram if not 1 <= s <= limit]:
        raise ValueError(f"sizes outside 1..{limit}: {bad[:5]}")
    return spark.createDataFrame(plan(histogram, limit), T.StructType([T.StructField(c, T.LongType()) for c in ("_size", "_first", "_many", "_bin", "offset")]))


def dealt(ranked: DataFrame, places: DataFrame, size: str, columns: list[str]) -> DataFrame:
    """ranked (size, _rank: the rank among items of its size) with sequence_id and offset. The plan is broadcast: it is
    bounded by `limit`, whatever the number of items."""
    there = (F.col(size) == F.col("_size")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_many"))
    return ranked.join(F.broadcast(places), there).select(*columns, (F.col("_bin") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")


def pack(items: DataFrame, limit: int, size: str = "length", key: str = "doc_id", shards: int = 256) -> DataFrame:
    """items with columns sequence_id and offset: best-fit decreasing of the whole table into sequences of `limit`.

    items must be cheap and stable to read again (a checkpoint or stored table). Sizes outside 1..limit raise an error
    in the plan. Ties (equal sizes) are dealt out by shard and key; repeated rows are packed as rows of their own. An
    empty table packs to an empty one. What reaches the driver and is broadcast is bounded by `limit` and `shards`:
    `limit` histogram rows, and the first ranks of `limit * shards` classes. No task holds a size: each is ranked in
    `shards` parts."""
    spark = items.sparkSession
    at = items.withColumn("_shard", F.pmod(F.xxhash64(key, size), F.lit(shards)).cast("int"))
    counts = cut(at.groupBy(F.col(size).alias("_size"), "_shard").agg(F.count("*").alias("_n")))
    histogram = {r["_size"]: r["n"] for r in counts.groupBy("_size").agg(F.sum("_n").alias("n")).collect()}
    places = planned(spark, histogram, limit)
    before = Window.partitionBy("_size").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("_size").alias("_of"), F.col("_shard").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(size, "_shard").orderBy(key)
    ranked = at.withColumn("_place", F.row_number().over(within) - 1)
    # Ranks and first ranks meet where the window has dealt the items already.
    ranked = ranked.join(firsts, (F.col(size) == F.col("_of")) & (F.col("_shard") == F.col("_in"))).select(*items.columns, (F.col("_base") + F.col("_place")).alias("_rank"))
    return dealt(ranked, places, size, items.columns)
