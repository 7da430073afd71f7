"""Problem 1: the most similar vectors for every vector.

Vectors are routed to shards by the nearest of a set of centres; a vector near
a border also asks the next shard. Centres are fitted in levels: ``width`` at
most from one bounded sample of all vectors, and where a cell of one level is
expected to get more than ``limit`` vectors, centres of its own from a sample
of its own rows on the next. So a shard holds about ``shard`` vectors and a
vector asks two more shards per level at most, whatever the number of vectors
(``plan``). Every shard builds a robust-pruned directed graph (``graph``) over
all its vectors, and beam search answers all queries routed to it, comparing
only the vectors it visits. Vectors travel as 16-bit floats (exact for values
that fit, else of the unit vector, an error below 0.001 of the cosine).

Defined results: only vectors of exactly ``DIMENSION`` finite values, not all
zero, take part; repeated ids count once; equal similarities go to the smaller
id. Of a group of more than k + 1 identical vectors the k + 1 smallest ids are
searched; the others are given the k smallest ids, which is their exact
result. Groups that are large beyond a shard are taken out before. A cell that
no centres can part is searched in graphs of ``graph`` vectors, which all its
queries ask. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm import graph
from tarnfold.storage import materialise

DIMENSION = 384
K = 10
#: Sampled vectors a centre needs; levels; rounds of fitting.
PER_CENTRE, LEVELS, ROUNDS = 16, 5, 8


@dataclass(frozen=True)
class Sizes:
    """``width``: centres that one level fits in one cell, at most (a sample is bounded by ``PER_CENTRE`` times that); ``shard``: vectors expected of a shard; ``limit``: those above which a cell is parted again; ``graph``: the most that one graph holds."""

    width: int = 1024
    shard: int = 4000
    limit: int = 9000
    graph: int = 12000


#: Shards of one task; rows of one task that routes the rows of a cell.
SHARDS, ROUTED = 4, 50_000
#: Copies of a vector above which its group is set apart before the search, the most common groups first, so many at most:
#: what is broadcast is bounded, and no other group has more copies than a share of 1 / HOT of all vectors.
COPIES, HOT = 1000, 10_000
#: A vector also asks the next centre's cell if that is at most so much less similar than its own; the second, for two more cells, where either is parted again.
MARGIN, WIDE_MARGIN = 0.02, 0.06
#: Results of a search that are also offered to the vectors found.
OFFERED = 20


def _vectors(column: pa.Array, ids: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float32 rows of the valid vectors of a batch."""
    right = pc.and_(pc.equal(pc.list_value_length(column), dimension), pc.is_valid(ids)).fill_null(False)
    column, ids = column.filter(right), ids.filter(right)
    flat = pc.list_flatten(column)
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)
    with np.errstate(invalid="ignore", over="ignore"):
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids.to_numpy(zero_copy_only=False)[ok].astype(np.int64), x[ok]


def _usable(vector: Column) -> Column:
    """The test of ``_vectors`` on values of the right number, as a column: none null, NaN or infinite, not all zero (NaN counts as the greatest)."""
    top, bottom = F.lit(float("inf")).cast("float"), F.lit(float("-inf")).cast("float")
    finite = (F.array_max(vector) < top) & (F.array_min(vector) > bottom) & ~F.array_contains(vector, top)  # null where a value is null
    return finite & ((F.array_max(vector) != 0) | (F.array_min(vector) != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _halves(x: np.ndarray) -> np.ndarray:
    """16-bit rows: the values themselves where they fit exactly, else those of the unit vector."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    bad = (half.astype(np.float32) != x).any(1)
    half[bad] = _unit(x[bad]).astype(np.float16)
    return half


def _pack(half: np.ndarray) -> list[bytes]:
    """Each row compressed without loss: its high bytes, then its low bytes, which are alike among themselves."""
    planes = np.ascontiguousarray(half.view(np.uint8).reshape(len(half), -1, 2).transpose(0, 2, 1))
    return [zlib.compress(row.tobytes(), 1) for row in planes]


def _unpack(rows: list[bytes], dimension: int) -> np.ndarray:
    planes = np.frombuffer(b"".join(map(zlib.decompress, rows)), np.uint8).reshape(len(rows), 2, dimension)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.float16).reshape(len(rows), dimension)


def _fit(sample: np.ndarray, centres: int) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    found = sample[np.random.RandomState(7).choice(len(sample), centres, False)]
    for _ in range(ROUNDS):
        near = (sample @ found.T).argmax(1)
        order = np.argsort(near, kind="stable")
        used, begin = np.unique(near[order], return_index=True)
        found[used] = np.add.reduceat(sample[order], begin)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return found


def plan(count: int, z: Sizes = Sizes()) -> list[int]:
    """Centres of a cell on each level for ``count`` vectors that spread evenly; their product is the number of shards."""
    out = [max(1, min(z.width, -(-count // z.shard)))]
    while count / math.prod(out) > z.limit and len(out) < LEVELS:
        out.append(max(2, min(z.width, round(count / math.prod(out) / z.shard))))
    return out


def _level(sample: np.ndarray, count: int, z: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Centres of one cell of ``count`` vectors from a sample of its unit vectors, and the vectors expected at each.

    A centre of too many is parted again as far as the sample and ``z.width`` allow.
    """
    found = _fit(sample, max(1, min(plan(count, z)[0], -(-len(sample) // PER_CENTRE), len(sample))))
    while True:
        near = (sample @ found.T).argmax(1)
        expected = np.bincount(near, minlength=len(found)) / len(sample) * count
        more, gone = [], []
        for c in np.flatnonzero(expected > z.limit):
            own = sample[near == c]
            n = min(-(-int(expected[c]) // z.shard), len(own) // (PER_CENTRE // 2), z.width - len(found) - sum(map(len, more)) + 1)
            if n > 1 and (own[1:] != own[0]).any():
                more.append(_fit(own, n))
                gone.append(c)
        if not more:
            return found, expected
        found = np.concatenate([np.delete(found, gone, 0), *more])
        if len(found) == z.width:
            near = (sample @ found.T).argmax(1)
            return found, np.bincount(near, minlength=len(found)) / len(sample) * count


def _share(key: str, wanted: Column) -> Column:
    """Whether a row is in the sample of its cell: its hashed key falls below a bound."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < wanted * (1 << 30)


def _first_level(rows: DataFrame, dimension: int, z: Sizes) -> tuple[np.ndarray, np.ndarray]:
    count = rows.count()
    got = rows.where(_share("_id", F.lit(min(1.0, z.width * PER_CENTRE / max(count, 1))))).toArrow()
    ids, x = _vectors(got.column(1).combine_chunks(), got.column(0).combine_chunks(), dimension)
    if not len(x):
        return np.zeros((1, dimension), np.float32), np.zeros(1)
    return _level(_unit(x[np.argsort(ids, kind="stable")]), count, z)


_ROUTED = "cell long, wide boolean, base boolean, _id long, v binary"


def _send(x: np.ndarray, base: np.ndarray, centres: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, row and whether it is the row's own place: the nearest centre, and for rows at home in this cell the next within the margin, one, or two where cells are parted again."""
    sims = x @ centres.T
    rows = np.arange(len(x))
    best = sims.argmax(1)
    top = sims[rows, best]
    to, row, own, last = [best], [rows], [base], best
    for turn in range(min(2, len(centres) - 1)):
        sims[rows, last] = -9
        last = sims.argmax(1)
        again = wide[best] | wide[last]
        asks = np.flatnonzero(base & (sims[rows, last] >= top - np.where(again, WIDE_MARGIN, MARGIN)) & (again | (turn == 0)))
        to.append(last[asks])
        row.append(asks)
        own.append(np.zeros(len(asks), bool))
    return np.concatenate(to), np.concatenate(row), np.concatenate(own)


def _route(centres: np.ndarray, wide: np.ndarray, dimension: int):
    """Routes all vectors by the centres of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _vectors(batch.column(1), batch.column(0), dimension)
            if len(ids):
                cell, row, base = _send(_unit(x), np.ones(len(ids), bool), centres, wide)
                packed = np.asarray([*_pack(_halves(x)), b""], object)[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(wide[cell]), pa.array(base), pa.array(ids[row]), pa.array(packed[row], pa.binary())], ["cell", "wide", "base", "_id", "v"])

    return run


def _fit_cell(dimension: int, z: Sizes):
    """Centres of one wide cell from the sample of its rows, and which of these are wide again."""

    def run(part: pa.Table) -> pa.Table:
        order = pa.array(np.argsort(part.column("_id").to_numpy(), kind="stable"))
        x = _unit(_unpack(part.column("v").take(order).to_pylist(), dimension).astype(np.float32))
        n = part.column("n")[0].as_py()
        found, expected = _level(x, n, z)
        return pa.table({"cell": part.column("cell")[:1], "n": pa.array([n], pa.int64()), "centres": pa.array([found.astype(np.float32).tobytes()], pa.binary()), "wider": pa.array([(expected > z.limit).tolist() if len(found) > 1 else [False]], pa.list_(pa.bool_()))})

    return run


def _route_cell(dimension: int, z: Sizes):
    """Routes rows of one wide cell by its own centres."""

    def run(part: pa.Table, fits: pa.Table) -> pa.Table:
        names = ["cell", "wide", "base", "_id", "v"]
        if not part.num_rows or not fits.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary())], names)
        centres = np.frombuffer(fits.column("centres")[0].as_py(), np.float32).reshape(-1, dimension)
        wide = np.asarray(fits.column("wider")[0].as_py(), bool)
        v = part.column("v").combine_chunks()
        found = [_send(_unit(_unpack(v[a : a + 4096].to_pylist(), dimension).astype(np.float32)), part.column("base").to_numpy()[a : a + 4096], centres, wide) for a in range(0, part.num_rows, 4096)]
        cell, row, base = (np.concatenate([f[j] + (4096 * i if j == 1 else 0) for i, f in enumerate(found)]) if j < 2 else np.concatenate([f[2] for f in found]) for j in range(3))
        above = part.column("cell")[0].as_py()
        return pa.table([pa.array(cell + (above + 1) * 2 * z.width), pa.array(wide[cell]), pa.array(base), part.column("_id").take(pa.array(row)), v.take(pa.array(row))], names)

    return run


def _shards(rows: DataFrame, dimension: int, z: Sizes) -> tuple[DataFrame, int]:
    """All vectors with the shard they belong to (``base``) and those they ask, and the number of tasks for these."""
    centres, expected = _first_level(rows, dimension, z)
    wide = expected > z.limit
    routed, tasks = rows.mapInArrow(_route(centres, wide, dimension), _ROUTED), -(-len(centres) // SHARDS)
    out = None
    for level in range(1, LEVELS):
        if not wide.any():
            break
        routed = materialise(routed, f"level{level}")
        narrow = routed.where("not wide")
        out = narrow if out is None else out.unionByName(narrow)
        within = routed.where("wide")
        sizes = within.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        wanted = F.least(F.lit(1.0), F.lit(PER_CENTRE) * F.least(F.lit(float(z.width)), F.ceil(F.col("n") / z.shard)) / F.col("n"))
        sample = within.join(sizes, "cell").where(_share("_id", wanted))
        fits = materialise(sample.groupBy("cell").applyInArrow(_fit_cell(dimension, z), "cell long, n long, centres binary, wider array<boolean>"), f"centres{level}")
        salts = F.ceil(F.col("n") / ROUTED).cast("int")
        salted = within.join(fits.select("cell", salts.alias("_salts")), "cell").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int")).drop("_salts")
        own = fits.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        routed = salted.groupBy("cell", "_salt").cogroup(own.groupBy("cell", "_salt")).applyInArrow(_route_cell(dimension, z), _ROUTED)
        held = fits.agg(F.sum(F.size("wider")).alias("n"), F.max(F.array_max("wider")).alias("more")).head()
        tasks, wide = tasks + -(-int(held.n or 0) // SHARDS), np.asarray([bool(held.more)])
    return (routed if out is None else out.unionByName(routed)), max(1, tasks)


_ANSWERS = "_id long, near array<long>, sim array<float>"


def _answers(ids: np.ndarray, near: np.ndarray, sims: np.ndarray) -> pa.Table:
    k = near.shape[1]
    ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * k)
    return pa.table({"_id": pa.array(ids), "near": pa.ListArray.from_arrays(ends, pa.array(near.ravel())), "sim": pa.ListArray.from_arrays(ends, pa.array(sims.ravel()))})


def _best(q: np.ndarray, near: np.ndarray, sims: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best distinct ``near`` of each of ``n`` queries, ties by ``near``; -1 and -9 where fewer."""
    order = np.lexsort((near, -sims, q))
    q, near, sims = q[order], near[order], sims[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (near[1:] != near[:-1])
    q, near, sims = q[once], near[once], sims[once]
    place = np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q]
    fit = place < k
    out, value = np.full((n, k), -1, np.int64), np.full((n, k), -9, np.float32)
    out[q[fit], place[fit]], value[q[fit], place[fit]] = near[fit], sims[fit]
    return out, value


def _search(k: int, dimension: int, z: Sizes):
    def run(shard: pa.Table) -> pa.Table:
        ids = shard.column("_id").to_numpy()
        base = shard.column("base").to_numpy()
        order = np.lexsort((ids, ~base))
        ids, base = ids[order], base[order]
        once = np.ones(len(ids), bool)
        once[1:] = ids[1:] != ids[:-1]
        order, ids, base = order[once], ids[once], base[once]
        half = _unpack(shard.column("v").take(pa.array(order)).to_pylist(), dimension)
        n = int(base.sum())
        rank, first = _ranks(half[:n], k)
        spare = np.flatnonzero(rank > k)
        extra = _answers(ids[spare], ids[first[spare]], np.ones((len(spare), k), np.float32)) if len(spare) else None
        keep = np.r_[rank <= k, np.ones(len(ids) - n, bool)]
        ids, n = ids[keep], n - len(spare)
        x = _unit(half[keep].astype(np.float32))
        asked, near, sims = [], [], []
        for a in range(0, n, z.graph):
            points = x[a : min(n, a + z.graph)]
            b = a + len(points)
            edges, entries, _ = graph.build(points)
            for c in range(0, len(ids), graph.BATCH):
                q = np.arange(c, min(len(ids), c + graph.BATCH))
                own = (q >= a) & (q < b)
                first = graph.starts(points, x[q], entries)
                first = np.concatenate([first, np.where(own[:, None], edges[np.where(own, q - a, 0), :8], -1)], 1)
                got, value, _ = graph.beam_search(edges, points, x[q], first)
                whose, other = np.broadcast_to(q[:, None], got.shape), got + a
                ok = (got >= 0) & (other != whose)
                back = ok & own[:, None] & (np.arange(got.shape[1]) < OFFERED)
                value = np.round(value, 6)
                asked += [whose[ok], other[back]]
                near += [other[ok], whose[back]]
                sims += [value[ok], value[back]]
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        found = join(near, np.int64)
        by_id, value = _best(join(asked, np.int64), ids[found], join(sims, np.float32), len(ids), k)
        out = _answers(ids, by_id, value)
        return out if extra is None else pa.concat_tables([out, extra])

    return run


def _ranks(half: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place among rows identical to it, and the first ``k`` of these (rows are in the order of ids)."""
    n = len(half)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, k), np.int64)
    _, group = np.unique(half.view(np.dtype((np.void, half.shape[1] * 2))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    begin = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n) - np.repeat(begin, np.diff(np.r_[begin, n]))
    first = order[np.minimum(begin[group][:, None] + np.arange(k), n - 1)]
    return rank, first


def nearest(df: DataFrame, key: str, vector: str, k: int = K, dimension: int = DIMENSION, z: Sizes = Sizes()) -> DataFrame:
    """For every valid vector its ``k`` most similar others: key, near (ids, best first), sim (cosines).

    Arrays are shorter only where fewer vectors exist. Other columns are not carried.
    """
    rows = df.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<float>").alias("_v")).where(F.col("_id").isNotNull() & (F.size("_v") == dimension))
    hashed = rows.where(_usable(F.col("_v"))).select("_id", F.xxhash64("_v").alias("_h"))
    hot = hashed.groupBy("_h").count().where(F.col("count") > COPIES).orderBy(F.desc("count"), "_h").limit(HOT).select("_h")
    copied = None
    if not hot.isEmpty():
        copies = hashed.join(F.broadcast(hot), "_h").distinct().withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(64)))
        first = copies.withColumn("_r", F.row_number().over(Window.partitionBy("_h", "_s").orderBy("_id"))).where(F.col("_r") <= k + 1)
        first = first.withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy("_id"))).where(F.col("_r") <= k + 1)
        least = materialise(first.groupBy("_h").agg(F.max("_id").alias("_most"), F.slice(F.sort_array(F.collect_list("_id")), 1, k).alias("near")), "copies")
        beyond = hashed.join(F.broadcast(least), "_h").where(F.col("_id") > F.col("_most")).select("_id", "near").dropDuplicates(["_id"])
        copied = beyond.select("_id", "near", F.transform("near", lambda _: F.lit(1.0).cast("float")).alias("sim"))
        rows = rows.withColumn("_h", F.xxhash64("_v")).join(F.broadcast(least.select("_h", "_most")), "_h", "left").where(F.col("_most").isNull() | (F.col("_id") <= F.col("_most"))).select("_id", "_v")
    routed, tasks = _shards(rows, dimension, z)
    found = routed.select("cell", "base", "_id", "v").repartition(tasks, "cell").groupBy("cell").applyInArrow(_search(k, dimension, z), _ANSWERS)
    one = F.filter(F.arrays_zip("sim", "near"), lambda e: e["near"] >= 0)
    merged = found.groupBy("_id").agg(F.flatten(F.collect_list(one)).alias("all"))
    best = F.slice(F.sort_array(F.transform("all", lambda e: F.struct((-e["sim"]).alias("far"), e["near"].alias("near")))), 1, k)
    searched = merged.select("_id", F.transform(best, lambda e: e["near"]).alias("near"), F.transform(best, lambda e: -e["far"]).alias("sim"))
    out = searched if copied is None else searched.unionByName(copied)
    return out.withColumnRenamed("_id", key)


def pairs(near: DataFrame, key: str) -> DataFrame:
    """Distinct pairs (id_a < id_b) of which at least one names the other."""
    each = near.select(F.col(key).alias("_q"), F.explode("near").alias("_n"))
    return each.select(F.least("_q", "_n").alias("id_a"), F.greatest("_q", "_n").alias("id_b")).distinct()
