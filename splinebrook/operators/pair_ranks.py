"""Rank correlation of all correlation distances with "labels differ", and its permutations, without a table of pairs.

Subjects with one label and equal vectors are one row with a count and the places they take. Distances, to so many digits, are cells
of a grid, and the grid is cut into ranges that one task each has room for: it works all pairs out in products of blocks, counts those
in its range by cell, and hands on sums. Mid-ranks of a range are those within it and what lies below, so sums over ranges give the
correlation exactly. Nothing of the size of the pairs is written or sent.

A permutation's sum of ranks over pairs with one label comes from products of blocks of ranks with the labels, every rank being the
mean rank of its bucket of cells. How far such a sum can be off follows from the counts, and a permutation that this leaves undecided
has its sum worked out in whole numbers from the ranks themselves, range by range.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import permutation as P
from .scratch import Steps

#: Rows and numbers of a block of vectors, and pairs of one product.
ROWS, NUMBERS, TOGETHER = 2048, 1 << 22, 1 << 16
#: Cells of a range, for each of which a task has two counts, and cells that are summed up at once.
CELLS, SLICE = 1 << 25, 1 << 20
#: Pairs that are sorted before they are counted.
BUFFER = 1 << 20
#: Buckets of cells at most, and for each subject.
BUCKETS, EACH = 1 << 23, 128
#: Places of a block that are permuted at once, times permutations.
MOVED = 1 << 22
#: Partitions of blocks; each two of them meet in one task.
PARTS = 64


def together(known: DataFrame, steps: Steps) -> tuple[DataFrame, list[int]]:
    """known (label, u, n, places) in blocks as stored, and the sizes of the groups in the order of labels."""
    groups = sorted((r[0], r[1]) for r in known.groupBy("label").agg(F.sum("n")).collect())
    codes = {label: k for k, (label, _) in enumerate(groups)}

    def pack(batches):
        number = itertools.count(TaskContext.get().partitionId() << 32)
        held, many = [], 0
        for batch in batches:
            while batch.num_rows:
                size = max(1, min(ROWS, NUMBERS // max(len(batch.column(1)[0]), 1)))
                held.append(batch.slice(0, max(0, size - many)))
                batch, many = batch.slice(held[-1].num_rows), many + held[-1].num_rows
                if many >= size:
                    yield block(next(number), held)
                    held, many = [], 0
        if held:
            yield block(next(number), held)

    def block(number, held):
        names, u, n, places = (pa.concat_arrays([b.column(k) for b in held]) for k in range(4))
        lists = [pa.array([codes[v] for v in names.to_pylist()], pa.int32()), n, u.flatten(), places.flatten()]
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists)], ["block", "codes", "n", "x", "places"])

    stored = steps.save(known.select("label", "u", "n", "places").mapInArrow(pack, "block long, codes array<int>, n array<long>, x array<double>, places array<long>"))
    return stored, [n for _, n in groups]


class Block:
    def __init__(self, batch, row: int, at: int = 0):
        self.number = batch.column(at)[row].as_py()
        self.codes, self.n, x, self.places = (batch.column(at + k).slice(row, 1).flatten().to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
        self.x = x.reshape(len(self.n), -1)
        self.starts = np.cumsum(self.n) - self.n
        self.ones = bool((self.n == 1).all())

    def products(self, other: Block):
        """(first row, products with all rows of the other), some rows at a time and always the same ones."""
        step = max(1, TOGETHER // len(other.x))
        for s in range(0, len(self.x), step):
            yield s, self.x[s : s + step] @ other.x.T

    def own(self, scale: int):
        """(row, cell) of the rows of several subjects, whose vectors are equal."""
        i = np.flatnonzero(self.n > 1)
        return i, cell_of((self.x[i] * self.x[i]).sum(axis=1), scale)

    def moved(self, ks: np.ndarray, borders: np.ndarray, seed: int) -> np.ndarray:
        """The group of each place (column) in each permutation (row)."""
        return np.searchsorted(borders, P.permuted(self.places, int(borders[-1]), P.GLOBAL, ks, seed), side="right").astype(np.int32)

    def members(self, moved: np.ndarray, group: int, kind=float) -> np.ndarray:
        """How many of a row's (column's) subjects are in a group, in each permutation."""
        own = moved == group
        return own.astype(kind) if self.ones else np.add.reduceat(own, self.starts, axis=1, dtype=kind)


def cell_of(product: np.ndarray, scale: int) -> np.ndarray:
    """Distances in units of the last digit, a half being rounded up; those that are not known come last, as NaN does."""
    t = np.clip(np.floor((1 - product) * scale + 0.5), 0, 2 * scale)
    return np.where(np.isnan(t), 2 * scale + 1, t).astype(np.int64)


def exact(value: np.ndarray, times: np.ndarray) -> int:
    """The sum of products of whole numbers, of which each half has room in 64 bits."""
    return (int((value >> 20) @ times) << 20) + int((value & 0xFFFFF) @ times)


def within(blocks: list[Block], low: int, size: int, scale: int):
    """(a, b, i, j, cell from low) of the pairs of rows with one of the `size` cells from low; b is None for pairs of a row's own
    subjects. A product tells roughly where its cell is, so few are looked at closer."""
    least = -np.inf if low + size > 2 * scale else 1 - (low + size + 1) / scale
    most = 1 - (low - 1) / scale if low else np.inf
    for p, a in enumerate(blocks):
        i, cell = a.own(scale)
        keep = np.flatnonzero((cell >= low) & (cell < low + size))
        if len(keep):
            yield a, None, i[keep], i[keep], cell[keep] - low
        for b in blocks[p:]:
            for s, v in a.products(b):
                v = v.ravel()
                at = np.flatnonzero(~((v < least) | (v > most)))
                if len(at):
                    cell = cell_of(v[at], scale)
                    i, j = np.divmod(at, len(b.x))
                    i += s
                    keep = np.flatnonzero((cell >= low) & (cell < low + size) & ((j > i) | (a is not b)))
                    yield a, b, i[keep], j[keep], cell[keep] - low


class Counts:
    """Pairs of each cell of a range, and those with one label: a sorted list while all of them are in one buffer, then a table."""

    def __init__(self, blocks: list[Block], low: int, size: int, scale: int, kind):
        self.size, self.kind, self.table = size, kind, None
        held, weights, many = [], [], 0
        for a, b, i, j, cell in within(blocks, low, size, scale):
            held.append((cell << 1 | (a.codes[i] == (b or a).codes[j])).astype(np.uint32))
            if b is None:
                weights.append(a.n[i] * (a.n[i] - 1) // 2)
            else:
                weights.append(None if a.ones and b.ones else a.n[i] * b.n[j])
            many += len(cell)
            if many >= BUFFER:
                self.add(*self.runs(held, weights))
                held, weights, many = [], [], 0
        last = self.runs(held, weights)
        if self.table is not None:
            self.add(*last)
            return
        cell, one, n = last
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else cell
        self.cell, self.n, self.alike = cell[first], np.add.reduceat(n, first) if len(n) else n, np.add.reduceat(n * one, first) if len(n) else n

    def runs(self, held, weights):
        """(cell, whether with one label, pairs), sorted by the first two."""
        keys = np.concatenate(held) if held else np.zeros(0, dtype=np.uint32)
        if all(w is None for w in weights):
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.append(first, len(keys)))
        else:
            n = np.concatenate([np.ones(len(k), dtype=np.int64) if w is None else w for k, w in zip(held, weights, strict=True)])
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
            n = np.add.reduceat(n, first) if len(n) else n
        return (keys[first] >> 1).astype(np.int64), (keys[first] & 1).astype(np.int64), n

    def add(self, cell, one, n):
        if self.table is None:
            self.table = np.zeros(self.size, dtype=self.kind), np.zeros(self.size, dtype=self.kind)
        n, one = n.astype(self.kind), one == 1
        self.table[0][cell[~one]] += n[~one]
        self.table[0][cell[one]] += n[one]
        self.table[1][cell[one]] += n[one]

    def slices(self):
        """(start of the slice, cells that occur, their pairs, those with one label, twice their mid-ranks in the range), by slices."""
        below = 0
        for s in range(0, self.size, SLICE):
            if self.table is None:
                lo, hi = np.searchsorted(self.cell, [s, s + SLICE])
                at, n, alike = self.cell[lo:hi] - s, self.n[lo:hi], self.alike[lo:hi]
            else:
                at = np.flatnonzero(self.table[0][s : s + SLICE])
                n, alike = (t[s : s + SLICE][at].astype(np.int64) for t in self.table)
            if len(at):
                up = np.cumsum(n)
                yield s, at, n, alike, 2 * (below + up) - n + 1
                below += int(up[-1])

    def settle(self):
        """Pairs with one label give way to pairs up to each cell, for ranks()."""
        for s, at, n, _, rank in self.slices():
            if self.table is not None:
                self.table[1][s + at] = (rank + n - 1) // 2
        if self.table is None:
            self.alike = np.cumsum(self.n)

    def ranks(self, cell):
        """Twice the mid-ranks, within the range, of cells that occur."""
        if self.table is None:
            at = np.searchsorted(self.cell, cell)
            return 2 * self.alike[at] - self.n[at] + 1
        return 2 * self.table[1][cell].astype(np.int64) - self.table[0][cell].astype(np.int64) + 1


def over_ranges(stored: DataFrame, scale: int, work, schema: str) -> list:
    """Rows of work(blocks, low) for each range. A range's task reads all blocks."""
    cells, ranges = CELLS, -(-(2 * scale + 2) // CELLS)

    def run(batches):
        blocks, at = [], None
        for batch in batches:
            for row in range(batch.num_rows):
                at = batch.column(0)[row].as_py()
                blocks.append(Block(batch, row, 1))
        if blocks:
            blocks.sort(key=lambda b: b.number)
            yield work(blocks, at * cells)

    every = stored.sparkSession.range(0, ranges, 1, ranges).toDF("range")
    return every.join(stored.coalesce(1).hint("shuffle_replicate_nl")).mapInArrow(run, schema).collect()


def totals(stored: DataFrame, sizes: list[int], scale: int, shift: int | None = None) -> dict:
    """m pairs, `alike` of them with one label, the sum of twice their centred ranks (seen), and of all squared centred ranks, times
    12 (squares); with a shift, twice the centred mean rank of each bucket of 2^shift cells and how far sums of these are off at most."""
    m, cells = sum(sizes) * (sum(sizes) - 1) // 2, CELLS
    kind = np.uint32 if m < 1 << 32 else np.int64

    def work(blocks, low):
        pairs = same = tie = seen = 0
        off, means = 0.0, np.zeros(cells >> shift if shift is not None else 0)
        for s, at, n, k, rank in Counts(blocks, low, cells, scale, kind).slices():
            pairs, same, seen = pairs + int(n.sum()), same + int(k.sum()), seen + exact(rank, k)
            tie += sum(int(c) * (int(v) ** 3 - int(v)) for v, c in zip(*np.unique(n, return_counts=True), strict=True))
            if shift is not None:
                bucket = at >> shift
                held, ranks = np.bincount(bucket, n), np.bincount(bucket, n * rank.astype(float))
                mean = np.divide(ranks, held, out=np.zeros(len(held)), where=held > 0)
                off += float((n * np.maximum(rank - mean[bucket], 0)).sum())
                means[s >> shift : (s >> shift) + len(mean)] = mean
        values = [low // cells, pairs, same, str(tie), str(seen), off, means.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["range", "pairs", "same", "tie", "seen", "off", "means"])

    found = sorted(over_ranges(stored, scale, work, "range long, pairs long, same long, tie string, seen string, off double, means binary"), key=lambda r: r["range"])
    below, out = 0, {"m": m, "alike": 0, "seen": 0, "squares": m**3 - m, "off": 0.0, "below": [], "means": []}
    for r in found:
        out["below"].append(below)
        out["alike"] += r["same"]
        out["seen"] += int(r["seen"]) + r["same"] * (2 * below - m - 1)
        out["squares"] -= int(r["tie"])
        out["off"] += r["off"]
        if shift is not None:
            out["means"].append(np.frombuffer(r["means"]) + (2 * below - m - 1))
        below += r["pairs"]
    if below != m and found:
        raise ValueError(f"{below} pairs of {m} were counted")
    return out


def rho_of(found: dict) -> float | None:
    """The rank correlation; None where all labels are equal or all differ, or all distances agree."""
    differ = found["m"] - found["alike"]
    if not (found["squares"] and differ and found["alike"]):
        return None
    return -found["seen"] / 2 / float(np.sqrt(found["squares"] / 12 * (differ / found["m"]) * found["alike"]))


def shuffled(stored: DataFrame, sizes: list[int], scale: int, found: dict, shift: int, n: int, seed: int) -> dict[int, float]:
    """For each permutation, twice the centred ranks of pairs with one label, from the buckets' means."""
    spark, borders = stored.sparkSession, np.cumsum(sizes)
    means = spark.sparkContext.broadcast(np.concatenate(found["means"]))
    blocks = stored.count()
    chunks = max(1, min(-(-4 * spark.sparkContext.defaultParallelism // max(1, blocks * (blocks + 1) // 2)), -(-(n + 1) // 32)))
    size = -(-(n + 1) // chunks)

    def add(batches):
        sums = np.zeros(n + 1)
        for batch in batches:
            for row in range(batch.num_rows):
                a, b, first = Block(batch, row), Block(batch, row, 6), batch.column(5)[row].as_py()
                if a.number == b.number:
                    b = a
                rank = np.zeros((len(a.x), len(b.x)))
                for s, v in a.products(b):
                    rank[s : s + len(v)] = means.value[cell_of(v, scale) >> shift]
                if a is b:
                    rank = np.triu(rank, 1)
                own, cell = a.own(scale) if a is b else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))
                twice = means.value[cell >> shift] / 2
                step = max(1, min(P.PERMUTATIONS, MOVED // max(len(a.places), len(b.places))))
                for k0 in range(first, min(first + size, n + 1), step):
                    ks = np.arange(k0, min(k0 + step, first + size, n + 1))
                    left = a.moved(ks, borders, seed)
                    right = left if a is b else b.moved(ks, borders, seed)
                    for g in range(len(borders)):
                        x, y = a.members(left, g), b.members(right, g)
                        if x.any() and y.any():
                            sums[ks] += ((x @ rank) * y).sum(axis=1) + (x[:, own] * (x[:, own] - 1)) @ twice
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(sums)], ["k", "same"])

    first = F.explode(F.array(*[F.lit(k) for k in range(0, n + 1, size)]))
    a = stored.withColumn("first", first).repartitionByRange(max(1, min(blocks * chunks, PARTS)), "block", "first")
    b = stored.repartitionByRange(max(1, min(blocks, PARTS)), "block").toDF(*(f"{c}_b" for c in stored.columns))
    met = a.join(b.hint("shuffle_replicate_nl"), F.col("block") <= F.col("block_b"))
    out = {r["k"]: r["same"] for r in met.mapInArrow(add, "k long, same double").groupBy("k").agg(F.sum("same").alias("same")).collect()}
    means.destroy()
    return out


def whole_sums(stored: DataFrame, sizes: list[int], scale: int, found: dict, some: list[int], seed: int) -> dict[int, int]:
    """`shuffled` for some permutations, from the ranks themselves and in whole numbers."""
    borders, m, below, cells = np.cumsum(sizes), found["m"], found["below"], CELLS
    kind, ks = np.uint32 if m < 1 << 32 else np.int64, np.array(some)

    def work(blocks, low):
        counts = Counts(blocks, low, cells, scale, kind)
        counts.settle()
        moved = {b.number: b.moved(ks, borders, seed) for b in blocks}
        held = {b.number: [b.members(moved[b.number], g, np.int32) for g in range(len(borders))] for b in blocks if not b.ones}
        sums, base = [0] * len(ks), 2 * below[low // cells] - m - 1

        def members(block, g, k, rows):
            return (moved[block.number][k, rows] == g) if block.ones else held[block.number][g][k, rows].astype(np.int64)

        for a, b, i, j, cell in within(blocks, low, cells, scale):
            rank = counts.ranks(cell) + base
            for k in range(len(ks)):
                if b is None:
                    own = [members(a, g, k, i) for g in range(len(borders))]
                    same = sum(x * (x - 1) // 2 for x in own)
                elif a.ones and b.ones:
                    same = (moved[a.number][k, i] == moved[b.number][k, j]).astype(np.int64)
                else:
                    same = sum(np.int64(1) * members(a, g, k, i) * members(b, g, k, j) for g in range(len(borders)))
                sums[k] += exact(rank, same)
        return pa.RecordBatch.from_arrays([pa.array([[str(v) for v in sums]])], ["sums"])

    parts = over_ranges(stored, scale, work, "sums array<string>")
    return {k: sum(int(r["sums"][at]) for r in parts) for at, k in enumerate(some)}


def hits(stored: DataFrame, sizes: list[int], scale: int, n: int, seed: int) -> tuple[dict, int]:
    """The totals, and how many of n permutations have no less rank on pairs that differ."""
    total, shift = sum(sizes), 0
    while (2 * scale + 2) >> shift > min(BUCKETS, max(1 << 16, EACH * total)) and 1 << shift < SLICE:
        shift += 1
    found = totals(stored, sizes, scale, shift)
    if rho_of(found) is None:
        return found, 0
    sums = shuffled(stored, sizes, scale, found, shift, n, seed)
    # sums of whole numbers below 2^52 are exact; others are off by their rounding too
    noise = 2.0 * found["alike"] * found["m"]
    off = 0.0 if found["off"] == 0 and noise < 1 << 52 else found["off"] * (1 + 1e-9) + noise * 1e-12
    near = [k for k in range(1, n + 1) if abs(sums[k] - found["seen"]) <= off] if off else []
    hit = sum(sums[k] <= found["seen"] for k in set(range(1, n + 1)).difference(near))
    step = max(1, 2 * MOVED // total)
    for at in range(0, len(near), step):
        hit += sum(v <= found["seen"] for v in whole_sums(stored, sizes, scale, found, near[at : at + step], seed).values())
    return found, hit
