"""Problem 4: near-duplicate records with small edits.

A record is a binary vector: its bits are the shingles it has. The method is
the general pigeonhole principle. Bits are grouped into partitions of
correlated bits: a shingle belongs to the partition of its rarest part (the
rarest of its words; of its triples of characters), so the shingles around one
word, which come and go together, lie in one partition. Let b <= a be the
sizes of two sets that share a fraction t of their union. The smaller then
lacks at most d = b - ceil(t (a + b) / (1 + t)) bits in the larger. Give each
partition g of the smaller a threshold T(g) >= -1 such that the T(g) + 1 sum
to d + 1: in some partition the larger lacks at most T(g) of the smaller's
bits.

The thresholds are unequal and every record's own: a dynamic program picks
those with the least estimated work, from counts of bits and parts in fixed
sketches. In a partition of correlated bits the records that hold any of the
k rarest bits are about those that hold the most common of these, so a
threshold of k - 1 is estimated at that bit's count. Bits that the sketch
calls unique lie in no other record and pay for a threshold by themselves.

The larger set is indexed, the smaller probes: in a partition with threshold T
the larger lacks at most T bits, so it holds one of the T + 1 rarest, and these
are probed. The index has the bits that some record probes (a filter tells;
what it lets through in error meets nothing). Probes meet the index by bit,
bounded by size, by the units spent before and by the distance of parity
sketches (never above the number of differing bits); common bits are split by
a salt. What meets is verified exactly on the full sets. The estimates change
the cost only.

Defined results: null, empty and short texts (fewer than ``least`` words) take
no part; equal sets form one class, whose least id represents it; repeated ids
count once; texts enter whole. An empty table gives no rows. Shingles are
hashed to 52 bits.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.storage import materialise

#: Slots of the sketch of bits, by the rows between these bounds, and their blocks; what is gathered is bounded. That of parts has a quarter.
LEAST_SLOTS, MOST_SLOTS, BLOCK = 1 << 20, 1 << 26, 1 << 16
#: Bits of the filters of probed bits and of keys to verify, by their number between these bounds.
LEAST_FILTER, MOST_FILTER = 1 << 20, 1 << 29
#: Records expected of one salt of a bit.
SALTED = 4096
#: Estimated work of a row that meets a probe, of a candidate, of a probe.
MEET, CANDIDATE, PROBE = 1.0, 1.0, 20.0
#: Units, beyond those of unique bits, that the dynamic program may spend in a partition.
STEPS = 6
#: Words of 64 bits of a record's parity sketch.
PARITY = 3
#: Equal sets above which only the one with the least id is probed and indexed, the most common first, so many at most (what is broadcast is bounded; others are met once per task).
COPIES, HOT = 64, 100_000
#: Copies of one text, equal to the byte, that are paired out; later ones are linked to the least id.
PAIRED = 64

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S, _G = np.uint64(33), np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 52) - 1)
#: Texts of one step: their numbers and 52 bits of a shingle sort as one number.
_PACK = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


#: White space that Arrow parts words at or lower case that it forms otherwise than wanted; such texts take the slow way.
_ODD = "[\\x0b\\x0cİΣ]"
_SPLIT = re.compile(r"[ \t\r\n]+").split


def _hashes(words: pa.Array) -> np.ndarray:
    """52-bit hashes of strings that are not empty: sums of random numbers, one for each byte and place."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    byte = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    size, begin = np.diff(ends), ends[:-1] - ends[0]
    place = np.arange(len(byte)) - np.repeat(begin, size)
    each = _mix((byte | (place.astype(np.uint64) << np.uint64(8))) * _G + np.uint64(1))
    return _mix(np.add.reduceat(each, begin) + size.astype(np.uint64)) >> np.uint64(12)


class Shingler:
    """Bits of texts: ``words`` consecutive words, or ``chars`` consecutive characters, hashed to 52 bits."""

    def __init__(self, words: int, chars: int, least: int):
        self.words, self.chars, self.least = words, chars, least

    def _codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words or characters of all texts in a row, and their number in each text."""
        if self.chars:
            own = [t.lower() if t else "" for t in texts.to_pylist()]
            return np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.asarray([len(t) for t in own], np.int64)
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, _ODD)
        parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        flat, size = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        if pc.any(pc.equal(flat, "")).as_py():
            keep = pc.not_equal(flat, "")
            whose = np.repeat(np.arange(len(size)), size)[keep.to_numpy(zero_copy_only=False)]
            flat, size = flat.filter(keep), np.bincount(whose, minlength=len(size))
        coded = flat.dictionary_encode()
        code = _hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
        which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(which):
            slow = [[w for w in _SPLIT(texts[int(k)].as_py().lower()) if w] for k in which]
            at = np.cumsum(size)[which]
            code = np.insert(code, np.repeat(at, [len(w) for w in slow]), _hashes(pa.array([w for own in slow for w in own], pa.string())))
            size[which] = [len(w) for w in slow]
        return code, size

    def bits(self, texts: pa.Array, parts: str = ""):
        """Sorted distinct bits of all texts in a row, and where each text's begin.

        With ``parts`` = "each" also the parts of every bit (bits, parts of a
        shingle); with "all" the distinct parts of every text in a row. Parts
        have 52 bits too.
        """
        k = self.words or self.chars
        code, size = self._codes(texts)
        takes = size >= max(self.least, k)
        count = np.where(takes, size - k + 1, 0)
        total = int(count.sum())
        if not total:
            empty = np.zeros(0, np.uint64), np.zeros(len(size) + 1, np.int64)
            return (*empty, np.zeros((0, 1), np.uint64)) if parts else empty
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), count)
        at = np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)
        h = np.zeros(total, np.uint64)
        for j in range(k):
            h = _mix(h * _G + code[at + j] + np.uint64(j + 1))
        above = owner.astype(np.uint64) << np.uint64(52)
        packed = (h & _LOW) | above
        if parts == "each":
            order = np.argsort(packed)
            packed = packed[order]
            once = np.r_[True, packed[1:] != packed[:-1]]
            packed, own = packed[once], self._parts(code, at[order[once]])
        else:
            packed.sort()
            packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
            if parts == "all":
                inner = np.sort(np.concatenate([own | above for own in self._parts(code, at).T]) if self.chars else (code | (np.repeat(np.arange(len(size)), size).astype(np.uint64) << np.uint64(52)))[np.repeat(takes, size)])
                own = inner[np.r_[True, inner[1:] != inner[:-1]]] & _LOW
        begin = np.r_[0, np.cumsum(np.bincount((packed >> np.uint64(52)).astype(np.int64), minlength=len(size)))]
        return (packed & _LOW, begin, own) if parts else (packed & _LOW, begin)

    def _parts(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The words of the shingles that begin at ``at``, or their triples of characters."""
        if self.words:
            return np.stack([code[at + j] for j in range(self.words)], 1)
        width = min(3, self.chars)
        out = []
        for j in range(self.chars - width + 1):
            h = np.zeros(len(at), np.uint64)
            for i in range(width):
                h = _mix(h * _G + code[at + j + i] + np.uint64(1))
            out.append(h & _LOW)
        return np.stack(out, 1)


def _keys(bits: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set that is not empty."""
    has = np.flatnonzero(np.diff(begin) > 0)
    out = np.zeros(len(begin) - 1, np.uint64)
    if len(has):
        out[has] = _mix(np.add.reduceat(_mix(bits ^ np.uint64(0x5851F42D4C957F2D)), begin[:-1][has]) + np.diff(begin)[has].astype(np.uint64))
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for whole in batches:
        for a in range(0, whole.num_rows, _PACK):
            part = whole.slice(a, _PACK)
            yield part.column(0), part.column(1)


def _levels(count: np.ndarray) -> np.ndarray:
    """Counts as levels: 0 none, 1 one, then eight to each doubling."""
    return np.minimum(np.where(count <= 1, count, np.ceil(8 * np.log2(np.maximum(count, 1)) - 6)), 255).astype(np.uint8)


#: The counts that the levels stand for.
_COUNTS = np.where(np.arange(256) <= 1, np.arange(256), np.floor(2 ** ((np.arange(256) + 6) / 8) + 1e-6))


def _slot(x: np.ndarray, slots: int) -> np.ndarray:
    return (_mix(x) & np.uint64(slots - 1)).astype(np.int64)


def _rarest(parts: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each bit the part with the least count, ties by hash: its partition."""
    best, least = parts[:, 0].copy(), level[:, 0].copy()
    for j in range(1, parts.shape[1]):
        less = (level[:, j] < least) | ((level[:, j] == least) & (parts[:, j] < best))
        best[less], least[less] = parts[less, j], level[less, j]
    return best


def _survey(shape: tuple[int, int, int], slots: int):
    """Members (_id, key, same: a hash of the text) of the texts that take part, and blocks of the sketches of their bits and parts."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots + slots // 4, np.int32)
        names, kind, counted = ["_id", "key", "same", "block", "data"], None, set()
        for ids, texts in _texts(batches):
            kind = ids.type
            bits, begin, parts = Shingler(*shape).bits(texts, "all")
            has = np.diff(begin) > 0
            n = int(has.sum())
            keys = _keys(bits, begin)
            same = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts.filter(pa.array(has)).to_pylist()), np.uint64, n)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(has)), pa.array(keys[has].view(np.int64)), pa.array(same.view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            for offset, width, x in ((0, slots, bits[_fresh(keys, has, counted)[np.repeat(np.arange(len(keys)), np.diff(begin))]]), (slots, slots // 4, parts)):
                slot = np.sort(_slot(x, width))
                begins = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])
                total[offset + slot[begins]] += np.diff(np.r_[begins, len(slot)]).astype(np.int32)
        blocks = total.reshape(-1, BLOCK)
        for b in np.flatnonzero(blocks.any(1)):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([int(b)], pa.int32()), pa.array([_squeeze(_levels(blocks[b]))], pa.binary())], names)

    return run


def _fresh(keys: np.ndarray, has: np.ndarray, met: set[int], ids: pa.Array | None = None, hot: dict | None = None) -> np.ndarray:
    """Which sets were not met before in this task; copies do the work of one. Of a hot set only the row with its least id counts."""
    out = np.zeros(len(keys), bool)
    for i in np.flatnonzero(has):
        if (k := int(keys[i])) not in met and (not hot or k not in hot or hot[k] == ids[int(i)].as_py()):
            met.add(k)
            out[i] = True
    return out


def _parity(bits: np.ndarray, owner: np.ndarray, records: int) -> np.ndarray:
    """Which of ``64 * PARITY`` places each record has an odd number of bits in: (records, ``PARITY``)."""
    spot = (_mix(bits + _G) % np.uint64(64 * PARITY)).astype(np.int64)
    odd = (np.bincount(owner * 64 * PARITY + spot, minlength=records * 64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(records, PARITY)


def _squeeze(block: np.ndarray) -> bytes:
    return zlib.compress(block.tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def _add_blocks(part: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK)
    for data in part.column("data").to_pylist():
        total += _COUNTS[_spread(data)]
    return pa.table({"block": pa.array([part.column("block")[0].as_py()], pa.int32()), "data": pa.array([_squeeze(_levels(total))], pa.binary())})


def _join_blocks(part: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.uint8)
    for data in part.column("data").to_pylist():
        total |= _spread(data)
    return pa.table({"block": pa.array([part.column("block")[0].as_py()], pa.int32()), "data": pa.array([_squeeze(total)], pa.binary())})


def _gathered(blocks: DataFrame, size: int, combine) -> np.ndarray:
    """``size`` bytes from compressed blocks of them, those of many tasks combined in two steps."""
    kind = "block int, data binary"
    some = blocks.select("block", "data", F.floor(F.spark_partition_id() / 64).alias("_s")).groupBy("block", "_s").applyInArrow(combine, kind)
    out = np.zeros((max(1, size // BLOCK), BLOCK), np.uint8)
    for block, data in some.groupBy("block").applyInArrow(combine, kind).collect():
        out[block] = _spread(data)
    return out.ravel()


def _filter(values: DataFrame, count: int) -> np.ndarray:
    """A filter (bytes of bits) of a column of longs, sized by their number."""
    size = _power(16.0 * count, LEAST_FILTER, MOST_FILTER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(size, bool)
        for batch in batches:
            mask[_slot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)] = True
        blocks = np.packbits(mask, bitorder="little").reshape(-1, BLOCK)
        for b in np.flatnonzero(blocks.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([_squeeze(blocks[b])], pa.binary())], ["block", "data"])

    return _gathered(values.mapInArrow(run, "block int, data binary"), size // 8, _join_blocks)


def _in(mask: np.ndarray, x: np.ndarray) -> np.ndarray:
    spot = _slot(x, len(mask) * 8)
    return (mask[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def _salts(count: np.ndarray) -> np.ndarray:
    """Salts of bits by their estimated counts."""
    return np.clip(np.ceil(count / SALTED), 1, 4095).astype(np.int64)


def allocate(cost: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The units of each partition with the least total cost, by dynamic programming.

    ``cost``: (records, partitions, units from 1 on), infinite where there are not so
    many; ``need``: the units that each record must reach at least. Returns
    (records, partitions) units; all -1 for a record that can't reach them.
    """
    records, groups, steps = cost.shape
    most = int(need.max())
    best = np.full((records, most + 1), np.inf, np.float32)
    best[:, 0] = 0
    chosen = np.zeros((groups, records, most + 1), np.uint8)
    for g in range(groups):
        now = best.copy()
        for u in range(1, steps + 1):
            c = cost[:, g, u - 1, None]
            if not np.isfinite(c).any():
                continue
            low = min(u, most)
            other = np.concatenate([np.broadcast_to(best[:, :1], (records, low)), best[:, : most + 1 - u]], 1) + c if u <= most else np.broadcast_to(best[:, :1], best.shape) + c
            better = other < now
            if better.any():
                now = np.where(better, other, now)
                chosen[g][better] = u
        best = now
    out = np.zeros((records, groups), np.int64)
    left, flat = need.astype(np.int64).copy(), np.arange(records)
    for g in range(groups - 1, -1, -1):
        out[:, g] = chosen[g, flat, left]
        left = np.maximum(left - out[:, g], 0)
    out[~np.isfinite(best[flat, need])] = -1
    return out


def _plan(owner: np.ndarray, width: np.ndarray, unique: np.ndarray, counts: np.ndarray, begin: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Units (a threshold and one) of every partition of a batch.

    Partitions stand in the order of their records: ``owner``, ``width`` (bits),
    ``unique`` (of these), ``counts`` (of all bits, ascending within a partition)
    from ``begin`` on; ``need``: units of each record. Unique bits are units for nothing.
    """
    n, records = len(owner), len(need)
    first = np.searchsorted(owner, np.arange(records))
    groups = np.diff(np.r_[first, n])
    out = unique.copy()
    need = need - np.bincount(owner, unique, minlength=records).astype(np.int64)
    step = np.arange(STEPS)
    at = begin[:, None] + unique[:, None] + step
    f = counts[np.minimum(at, len(counts) - 1)]
    work = PROBE * _salts(f) + MEET * f
    cost = np.where(unique[:, None] + step < width[:, None], np.cumsum(work, 1) + CANDIDATE * f, np.inf).astype(np.float32)
    todo = np.flatnonzero((groups > 0) & (need > 0))
    todo = todo[np.lexsort((groups[todo], need[todo]))]
    a = 0
    while a < len(todo):
        b = a + 1
        while b < len(todo) and b - a < 512 and (b - a) * groups[todo[a:b]].max() * (need[todo[b]] + 1) < 2_000_000 and need[todo[b]] <= need[todo[a]] + 4:
            b = min(len(todo), b + 32)
        rows = todo[a:b]
        place = first[rows][:, None] + np.arange(groups[rows].max())[None]
        real = np.arange(place.shape[1])[None] < groups[rows][:, None]
        place = np.where(real, place, 0)
        picked = allocate(np.where(real[:, :, None], cost[place], np.float32(np.inf)), need[rows])
        picked = np.where(picked < 0, (width - unique)[place], picked)
        out[place[real]] += picked[real]
        a = b
    return out


_PARITIES = [f"s{j}" for j in range(PARITY)]
_ROW = "key long, size int" + "".join(f", {s} long" for s in _PARITIES)


def _salted(bits: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Bits with a salt in the places above them."""
    return (bits | (salt.astype(np.uint64) << np.uint64(52))).view(np.int64)


def _partitions(sketches: Broadcast, slots: int, hot: Broadcast, shape: tuple[int, int, int], t: float):
    """The probes of all texts: the bits of partitions with a threshold, and the units spent on partitions before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(sketches.value, np.uint8)
        met: set[int] = set()
        for ids, texts in _texts(batches):
            bits, begin, parts = Shingler(*shape).bits(texts, "each")
            keys = _keys(bits, begin)
            fresh = _fresh(keys, np.diff(begin) > 0, met, ids, hot.value)
            if not fresh.any():
                continue
            size = np.where(fresh, np.diff(begin), 0)
            owner = np.repeat(np.arange(len(size)), np.diff(begin))
            use = fresh[owner]
            bits, parts, owner = bits[use], parts[use], owner[use]
            parity = _parity(bits, owner, len(size))
            part = _rarest(parts, levels[slots + _slot(parts, slots // 4)])
            level = levels[_slot(bits, slots)]
            packed = (owner.astype(np.uint64) << np.uint64(52)) | ((part >> np.uint64(8)) << np.uint64(8)) | level
            order = np.argsort(packed)
            packed, bits, whose, count = packed[order] >> np.uint64(8), bits[order], owner[order], _COUNTS[level[order]]
            first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
            width, owner = np.diff(np.r_[first, len(bits)]), whose[first]
            unique = np.add.reduceat((count <= 1).astype(np.int64), first)
            need = np.where(size > 0, size - np.ceil(2 * t / (1 + t) * size - 1e-9).astype(np.int64) + 1, 0)
            units = _plan(owner, width, unique, count, first, need)
            spent = units - unique
            work = np.where(spent > 0, count[first + np.maximum(units, 1) - 1], 0)
            rank = np.lexsort((work, owner))  # partitions in the order of their records, the cheapest first
            before = np.empty(len(rank), np.int64)
            sums = np.cumsum(units[rank]) - units[rank]
            begins = np.searchsorted(owner, np.arange(len(size)))
            before[rank] = sums - np.r_[sums, 0][np.minimum(begins, len(sums) - 1)][owner]
            probes = np.flatnonzero(spent > 0)
            of = np.repeat(probes, spent[probes])
            at = first[of] + unique[of] + np.arange(len(of)) - np.repeat(np.cumsum(spent[probes]) - spent[probes], spent[probes])
            o = owner[of]
            by = np.argsort(o, kind="stable")
            at, of, o = at[by], of[by], o[by]
            ends = np.searchsorted(o, np.arange(len(size) + 1))
            has = np.flatnonzero(np.diff(ends))
            offsets = pa.array(np.r_[ends[has], len(o)].astype(np.int32))
            salts = _salts(count[at])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(c))) for c in (bits[at].view(np.int64), before[of].astype(np.int32), salts.astype(np.int32))]
            columns = [pa.array(np.ascontiguousarray(c)) for c in (keys[has].view(np.int64), size[has].astype(np.int32), *parity[has].T)]
            yield pa.RecordBatch.from_arrays([*columns, *lists], ["key", "size", *_PARITIES, "bits", "befores", "salts"])

    return run


def _index(sketches: Broadcast, slots: int, hot: Broadcast, probed: Broadcast, shape: tuple[int, int, int]):
    """The bits of all texts that some text probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, mask = np.frombuffer(sketches.value, np.uint8), np.frombuffer(probed.value, np.uint8)
        met: set[int] = set()
        for ids, texts in _texts(batches):
            bits, begin = Shingler(*shape).bits(texts)
            keys, size = _keys(bits, begin), np.diff(begin)
            owner = np.repeat(np.arange(len(size)), size)
            parity = _parity(bits, owner, len(size))
            use = np.flatnonzero(_in(mask, bits) & _fresh(keys, size > 0, met, ids, hot.value)[owner])
            bits, owner = bits[use], owner[use]
            count = _COUNTS[levels[_slot(bits, slots)]]
            salt = keys[owner] % _salts(count).astype(np.uint64)
            columns = [keys[owner].view(np.int64), size[owner].astype(np.int32), *parity[owner].T, _salted(bits, salt)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "size", *_PARITIES, "bit"])

    return run


def _sets(wanted: Broadcast, shape: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(wanted.value, np.uint8)
        met: set[int] = set()
        for _, texts in _texts(batches):
            bits, begin = Shingler(*shape).bits(texts)
            keys = _keys(bits, begin)
            which = np.flatnonzero(_fresh(keys, (np.diff(begin) > 0) & _in(mask, keys), met))
            yield pa.RecordBatch.from_arrays([pa.array(keys[which].view(np.int64)), pa.array([bits[begin[k] : begin[k + 1]].tobytes() for k in which], pa.binary())], ["key", "bits"])

    return run


def _verify(t: float):
    """Similarities of many pairs at once: what two sets share is what stands twice among the bits of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for c in range(0, whole.num_rows, 1024):
                batch = whole.slice(c, 1024)
                sides = [batch.column(j) for j in (2, 3)]
                sizes = [pc.binary_length(s).to_numpy(zero_copy_only=False).astype(np.int64) // 8 for s in sides]
                bits = [np.frombuffer(b"".join(s.to_pylist()), np.uint64) | np.repeat(np.arange(batch.num_rows, dtype=np.uint64) << np.uint64(52), n) for s, n in zip(sides, sizes)]
                both = np.sort(np.concatenate(bits))
                twice = both[1:][both[1:] == both[:-1]] >> np.uint64(52)
                shared = np.bincount(twice.astype(np.int64), minlength=batch.num_rows)
                out = shared / np.maximum(sizes[0] + sizes[1] - shared, 1)
                good = pa.array(out >= t - 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(out).filter(good)], ["key_a", "key_b", "similarity"])

    return run


def _power(n: float, least: int, most: int) -> int:
    """The power of two from ``n`` on, between two others."""
    return min(most, max(least, 1 << max(0, math.ceil(math.log2(max(n, 1))))))


def similar(df: DataFrame, key: str, text: str, threshold: float, words: int = 0, chars: int = 0, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal sets, and the members of the classes.

    Links: key_a, key_b (of classes), similarity, once per pair with
    ``threshold`` or more. Members: ``key``, ``_class`` and ``_same`` (a
    hash of the text itself) of every text that takes part. Give either ``words`` or ``chars`` per shingle.
    """
    if bool(words) == bool(chars) or not 0 < threshold <= 1:
        raise ValueError("give words or chars, and a threshold above 0 and at most 1")
    spark, shape, t = df.sparkSession, (words, chars, least), threshold
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.col("_id").isNotNull() & (F.length("_text") > 0))
    slots = _power(64.0 * df.count(), LEAST_SLOTS, MOST_SLOTS)
    survey = materialise(rows.mapInArrow(_survey(shape, slots), f"_id {kind}, key long, same long, block int, data binary"), "survey")
    sketches = spark.sparkContext.broadcast(_gathered(survey.where("block is not null"), slots + slots // 4, _add_blocks).tobytes())
    copies = survey.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_id")).where("n > %d" % COPIES)
    hot = spark.sparkContext.broadcast({r.key % (1 << 64): r._id for r in copies.orderBy(F.desc("n"), "key").limit(HOT).collect()})
    probing = materialise(rows.mapInArrow(_partitions(sketches, slots, hot, shape, t), f"{_ROW}, bits array<long>, befores array<int>, salts array<int>"), "probes")
    count = probing.agg(F.sum(F.size("bits"))).head()[0] or 0
    probed = spark.sparkContext.broadcast(_filter(probing.select(F.explode("bits")), count).tobytes())
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("z.salts") - 1), lambda salt: F.col("z.bits").bitwiseOR(F.shiftleft(salt.cast("long"), 52))))
    p = probing.select("key", "size", *_PARITIES, F.explode(F.arrays_zip("bits", "befores", "salts")).alias("z")).select("key", "size", *_PARITIES, F.col("z.befores").alias("before"), spread.alias("bit")).alias("p")
    i = rows.mapInArrow(_index(sketches, slots, hot, probed, shape), f"{_ROW}, bit long").alias("i")
    need = F.ceil(t / (1 + t) * (F.col("p.size") + F.col("i.size")) - 1e-9)
    apart = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"p.{s}").bitwiseXOR(F.col(f"i.{s}"))) for s in _PARITIES])
    met = (F.col("p.bit") == F.col("i.bit")) & ((F.col("p.size") < F.col("i.size")) | ((F.col("p.size") == F.col("i.size")) & (F.col("p.key") < F.col("i.key"))))
    met &= (F.col("p.size") >= t * F.col("i.size") - 1e-9) & (F.col("p.before") <= F.col("p.size") - need) & (apart <= F.col("p.size") + F.col("i.size") - 2 * need)
    candidates = materialise(p.join(i, met).select(F.col("i.key").alias("key_a"), F.col("p.key").alias("key_b")).distinct(), "candidates")
    ends = candidates.select("key_a").union(candidates.select("key_b"))
    wanted = spark.sparkContext.broadcast(_filter(ends, candidates.count()).tobytes())
    sets = materialise(rows.mapInArrow(_sets(wanted, shape), "key long, bits binary"), "sets").groupBy("key").agg(F.any_value("bits").alias("bits"))
    paired = candidates.join(sets.withColumnsRenamed({"key": "key_a", "bits": "bits_a"}), "key_a").join(sets.withColumnsRenamed({"key": "key_b", "bits": "bits_b"}), "key_b")
    links = materialise(paired.select("key_a", "key_b", "bits_a", "bits_b").mapInArrow(_verify(t), "key_a long, key_b long, similarity double"), "links")
    members = materialise(survey.where("key is not null").select(F.col("_id").alias(key), F.col("key").alias("_class"), F.col("same").alias("_same")).groupBy(key, "_class").agg(F.min("_same").alias("_same")), "members")
    return links, members


def classes(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """One row per record: key, class_id (the least key of equal sets) and the links of its class to others."""
    least = members.groupBy("_class").agg(F.min(key).alias("class_id"))
    ends = links.select(F.col("key_a").alias("_class")).union(links.select(F.col("key_b").alias("_class"))).groupBy("_class").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(least, "_class").join(ends, "_class", "left").select(key, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Pairs id_a < id_b: within classes and between linked classes.

    The members of all classes are paired out, but for copies equal to the byte:
    of these the ``PAIRED`` least ids are, and each later one is linked to the
    least, so no link between different texts is lost.
    """
    text = ["_class", "_same"]
    many = members.groupBy(*text).agg(F.count(F.lit(1)).alias("n")).where("n > %d" % PAIRED).select(*text)
    of_many = members.join(many, text).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)))
    for part in ([*text, "_s"], text):
        of_many = of_many.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(key))).where("_r <= %d" % PAIRED)
    front = materialise(of_many.groupBy(*text).agg(F.min(key).alias("least"), F.max(key).alias("most")), "front")
    each = members.join(front, text, "left")
    later = F.col("most").isNotNull() & (F.col(key) > F.col("most"))
    star = each.where(later).select(F.col("least").alias("id_a"), F.col(key).alias("id_b"))
    few = materialise(each.where(~later).select("_class", F.col(key).alias("id")), "copies")
    sized = few.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_class")
    shared = few.join(sized, "_class")
    inside = shared.alias("a").join(shared.alias("b"), (F.col("a._class") == F.col("b._class")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    between = links.select("key_a", "key_b").join(few.withColumnsRenamed({"_class": "key_a", "id": "x"}), "key_a").join(few.withColumnsRenamed({"_class": "key_b", "id": "y"}), "key_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return inside.union(star).union(between).distinct()
