"""Problem 8: filling fixed-capacity containers by minimum bin slack.

Only the sizes matter for the plan: their counts are a table of at most
``capacity`` rows however large the corpus is. Starting from the largest size
left, a bitset subset-sum over the remaining multiset of sizes finds the fill
closest to the capacity; the sizes used are backtracked with their counts, and
the pattern is repeated as often as the counts allow. Each repetition uses up
at least one size, so the plan has few patterns. Items are then numbered
within their size, in blocks, and placed by arithmetic on the plan.

An item above the capacity is divided into full containers and one rest.

Defined results: an item of size 0 takes no space and goes to container 0;
repeated keys are each packed; an empty table gives no rows; containers are
numbered from 0 and positions within one follow the items' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.storage import materialise

CAPACITY = 2048
#: Rows that one numbering block holds about.
BLOCK = 200_000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of sizes, within ``counts``, whose sum is the largest not above ``room``.

    Subset sums are the bits of one integer; multiplicities are split into
    powers of two, so a size enters at most log2 of its count times. Larger
    sizes come first, so small ones stay for later fills.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((s for s in counts if 0 < s <= room and counts[s] > 0), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left > 0:
            n = min(take, left)
            wider = (reach | reach << size * n) & full
            if wider != reach:
                steps.append((size, n, reach))
                reach = wider
            left -= n
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for size, n, before in reversed(steps):
        if not before >> total & 1:
            used[size] = used.get(size, 0) + n
            total -= size * n
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns (repetitions, {size: count}) that use up ``counts``, sizes 1 to ``capacity``."""
    left = {s: n for s, n in counts.items() if n > 0}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        used = fill(left, capacity - top)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[s] // n for s, n in used.items())
        out.append((times, used))
        for s, n in used.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
    return out


def _places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the first number of every stretch of items, the stretch's first container, the items per container."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    met: dict[int, int] = {}
    container = 0
    for times, used in patterns:
        for size, n in used.items():
            found.setdefault(size, []).append((met.get(size, 0), container, n))
            met[size] = met.get(size, 0) + times * n
        container += times
    return {s: tuple(np.asarray(x, np.int64) for x in zip(*v)) for s, v in found.items()}


def _place(places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy(zero_copy_only=False)
            number = batch.column(3).to_numpy(zero_copy_only=False)
            container = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                if s in places:
                    which = np.flatnonzero(size == s)
                    begin, first, per = places[s]
                    k = np.searchsorted(begin, number[which], "right") - 1
                    container[which] = first[k] + (number[which] - begin[k]) // per[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container)], ["_key", "piece_index", "size", "container_id"])

    return run


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Key, piece_index, size and container_id of every piece of the items of ``df``.

    Null sizes count as 0. Other columns are not carried.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = df.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("_n"))
    pieces = F.greatest(F.ceil(F.col("_n") / capacity), F.lit(1)).cast("int")
    cut = items.select("_key", F.posexplode(F.transform(F.sequence(F.lit(1), pieces), lambda i: F.least(F.lit(capacity).cast("long"), F.col("_n") - (i - 1) * capacity))).alias("piece_index", "size"))
    rows = materialise(cut, "items")
    counted = rows.count()
    blocks = max(1, -(-counted // BLOCK))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_key", "piece_index"), F.lit(blocks)))
    by = rows.where("size > 0").groupBy("size", "_b").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in by.groupBy("size").agg(F.sum("n")).collect()}
    places = _places(plan(counts, capacity))
    before = by.withColumn("_before", F.sum("n").over(Window.partitionBy("size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("size", "_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = Window.partitionBy("size", "_b").orderBy("_key", "piece_index")
    numbered = rows.where("size > 0").withColumn("_r", F.row_number().over(inside) - 1).join(before, ["size", "_b"]).select("_key", "piece_index", "size", (F.col("_r") + F.col("_before")).alias("_number"))
    empty = rows.where("size = 0").select("_key", "piece_index", "size", F.lit(0).cast("long").alias("_number"))
    kind = df.schema[key].dataType.simpleString()
    return numbered.unionByName(empty).mapInArrow(_place(places), f"_key {kind}, piece_index int, size long, container_id long").withColumnRenamed("_key", key)
