"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to unit length and turned onto the principal axes of a covariance that is summed over all vectors, so
that the leading coordinates hold most of the length. Equal vectors are collapsed. The rest is ordered along a curve
through the leading axes (their coordinates' bits, interleaved) and range-partitioned into tiles, which are boxes on these
axes; two tiles are compared only if their boxes come close enough, which is asked of groups of neighbouring tiles first.
Within a pair of tiles the products are summed over the leading coordinates first; what the others can still add is at most
the product of the two suffix norms, and a pair of vectors is dropped once that cannot reach the threshold. Pairs that are
left are decided by the cosine of the given vectors in double precision.

A unit of work holds a group of tiles and lets the tiles that it has to meet pass by, a bounded number of them. Links are
turned into counts and into a star for each linked group a strip of vectors at a time, so all of a tile may link with all.

Vectors that are null, empty, zero, of another dimension than the most common one, or that hold null or non-finite
components link with nothing and are their own component. Ids should be unique longs; each row with a null or a repeated id
still gives one row, and counts as a vector of its own, but a null id can't name a component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, total_rows
from .components import connected, local_roots

THRESHOLD = 0.9
#: Vectors of a tile; a pair of tiles of 64 doubles each is 4 MB.
TILE = 4096
#: Coordinates added at a time, and the axes on which tiles have boxes, with bits of a coordinate on the curve.
STEPS = (16, 32)
BOX_AXES = 8
CURVE_BITS = 7
#: Vectors of a tile compared with the other tile at a time.
STRIP = 256
#: Tiles that a unit of work holds, and tiles that pass by, at most; with few tiles also this part of them, so that there
#: are units enough.
HELD = 8
PASSING = 64
UNITS = 8
#: Tiles whose boxes are joined into one before tiles are looked at.
GROUP = 512
#: Allowance for single precision in the bounds; decisions are made in double precision.
SLACK = 1e-4


def usable(column: str) -> F.Column:
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0)


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Columns: principal axes of the unit vectors, largest variance first; sums of dims x dims only reach the driver."""

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = unit(matrix(batch.column(0), dims))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["k", "v"])

    sums = vectors.select("vector").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    moment = np.zeros(dims * dims)
    for row in sums:
        moment[row["k"]] = row["v"]
    _, axes = np.linalg.eigh(moment.reshape(dims, dims))
    return axes[:, ::-1]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) with a cosine of threshold or more, a strip of a at a time; rows are the given vectors."""
    x, y = unit(a), unit(b)
    u, v = (x @ axes).astype(np.float32), (y @ axes).astype(np.float32)
    dims, cuts = u.shape[1], [*[s for s in STEPS if s < u.shape[1]], u.shape[1]]
    suffix_u = [np.linalg.norm(u[:, c:], axis=1) for c in cuts]
    suffix_v = [np.linalg.norm(v[:, c:], axis=1) for c in cuts]
    least = np.float32(threshold - SLACK)
    # the bound in one product: the suffix norm is one more coordinate
    lead_u, lead_v = (np.hstack([w[:, : cuts[0]], n[0][:, None]]) for w, n in ((u, suffix_u), (v, suffix_v)))
    lead_v = np.ascontiguousarray(lead_v.T)
    for start in range(0, len(u), STRIP):
        part = u[start : start + STRIP]
        bounds = lead_u[start : start + STRIP] @ lead_v
        i, j = np.divmod(np.flatnonzero(bounds >= least), len(v))
        some = bounds[i, j] - suffix_u[0][start + i] * suffix_v[0][j]
        for k in range(1, len(cuts)):
            if not len(i):
                break
            # survivors may be few or nearly all: chunk them, to bound memory
            for lo in range(0, len(i), 1 << 18):
                p, q = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
                some[lo : lo + (1 << 18)] += np.einsum("ij,ij->i", part[p, cuts[k - 1] : cuts[k]], v[q, cuts[k - 1] : cuts[k]])
            stays = some + suffix_u[k][start + i] * suffix_v[k][j] >= least
            i, j, some = i[stays], j[stays], some[stays]
        for lo in range(0, len(i), 1 << 18):
            p, q = i[lo : lo + (1 << 18)] + start, j[lo : lo + (1 << 18)]
            sure = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
            yield p[sure], q[sure]
    assert dims == axes.shape[0]


@dataclass
class Tile:
    nodes: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, r: int, dims: int) -> Tile:
        nodes, copies, vectors = (np.asarray(batch.column(c)[r].values) for c in (4, 5, 6))
        return Tile(nodes, copies, vectors.astype(np.float64).reshape(-1, dims))

    def links(self, other: Tile, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, root) of the linked ones of both tiles: weighted counts and stars."""
        same = self is other or np.array_equal(self.nodes, other.nodes)
        n = len(self.nodes)
        nodes = self.nodes if same else np.concatenate([self.nodes, other.nodes])
        counts, roots = np.zeros(len(nodes)), np.arange(len(nodes))
        for p, q in compare(self.vectors, other.vectors, axes, threshold):
            counts[:n] += np.bincount(p, weights=other.copies[q] * ~(same & (p == q)), minlength=n)
            if not same:
                counts[n:] += np.bincount(q, weights=self.copies[p], minlength=len(other.nodes))
                q = q + n
            roots = local_roots(len(nodes), roots[p], roots[q])[roots]
        some = counts > 0
        return nodes[some], counts[some].astype(np.int64), nodes[roots[some]]


def tile_links(tiles: DataFrame, pairs: DataFrame, axes: np.ndarray, dims: int, threshold: float, n_tiles: int) -> DataFrame:
    """tiles: (tile, nodes, copies, vectors); pairs: (i, j), i <= j -> rows (node, links, root): partial counts and stars."""
    part = max(1, n_tiles // UNITS)
    unit_of = [F.floor(F.col("i") / min(HELD, part)).alias("g"), F.floor(F.col("j") / min(PASSING, part)).alias("s")]
    load = [F.col(c) for c in ("nodes", "copies", "vectors")]
    held = pairs.select(*unit_of, F.col("i").alias("tile")).distinct().join(tiles, "tile").select("g", "s", F.col("tile").alias("number"), F.lit(None).cast("array<bigint>").alias("meets"), *load)
    passing = pairs.groupBy(*unit_of, F.col("j").alias("tile")).agg(F.collect_list("i").alias("meets"))  # HELD at most
    passing = passing.join(tiles, "tile").select("g", "s", F.col("tile").alias("number"), "meets", *load)
    dealt = held.unionByName(passing).repartition("g", "s").sortWithinPartitions("g", "s", F.col("meets").isNotNull(), "number")

    def run(batches):
        unit_at, own = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                at = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                if at != unit_at:
                    unit_at, own = at, {}
                tile, meets = Tile.of(batch, r, dims), batch.column(3)[r].as_py()
                if meets is None:
                    own[batch.column(2)[r].as_py()] = tile
                    continue
                for i in sorted(meets):
                    found = own[i].links(tile, axes, threshold)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "links", "root"])

    return dealt.mapInArrow(run, "node long, links long, root long")


def near_tiles(boxes: DataFrame, axes: int, reach: float) -> DataFrame:
    """Pairs (i, j), i <= j, of tiles whose boxes come within the squared distance reach: groups of tiles first, then theirs."""

    def close(left: str, right: str) -> Column:
        gaps = [F.greatest(F.col(f"{left}.lo{k}") - F.col(f"{right}.hi{k}"), F.col(f"{right}.lo{k}") - F.col(f"{left}.hi{k}"), F.lit(0.0)) for k in range(axes)]
        return sum(g * g for g in gaps) <= reach

    grouped = boxes.withColumn("group", F.floor(F.col("tile") / GROUP))
    spans = [f(f"{name}{k}").alias(f"{name}{k}") for k in range(axes) for name, f in (("lo", F.min), ("hi", F.max))]
    groups = grouped.groupBy("group").agg(*spans)
    met = groups.alias("a").join(groups.alias("b"), (F.col("a.group") <= F.col("b.group")) & close("a", "b")).select(F.col("a.group").alias("ga"), F.col("b.group").alias("gb"))
    both = met.join(grouped.alias("a"), F.col("a.group") == F.col("ga")).join(grouped.alias("b"), (F.col("b.group") == F.col("gb")) & (F.col("a.tile") <= F.col("b.tile")) & close("a", "b"))
    return both.select(F.col("a.tile").alias("i"), F.col("b.tile").alias("j"))


def curve(heads: np.ndarray) -> np.ndarray:
    """Places on a curve through the leading axes: bits of the coordinates (of unit vectors), interleaved from the highest."""
    levels = ((np.clip(heads, -1, 1) + 1) / 2 * ((1 << CURVE_BITS) - 1)).astype(np.int64)
    place = np.zeros(len(heads), dtype=np.int64)
    for bit in range(CURVE_BITS - 1, -1, -1):
        for k in range(heads.shape[1]):
            place = place << 1 | (levels[:, k] >> bit & 1)
    return place


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of df; ids should be unique longs.

    n_links counts the other vectors with a cosine of threshold or more, component_id is the smallest id reachable by
    links, itself included, and kept marks the rows that carry it.
    """
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).withColumn("usable", F.coalesce(usable("vector"), F.lit(False)))
    sizes = rows.filter("usable").groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return finished(alone(rows), id_col)
    dims = int(sizes["d"])
    fits = F.col("usable") & (F.size("vector") == dims)
    fit = rows.filter(fits)
    axes = principal_axes(fit, dims)
    # equal vectors: one node with the number of copies
    digests = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(17), "vector").alias("h2")]
    grouped = fit.select("id", "vector", *digests).groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    lead = axes[:, :BOX_AXES]
    kind = "array<float>" if single else "array<double>"

    def place():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            heads = unit(matrix(batch.column(4), dims)) @ lead
            listed = pa.FixedSizeListArray.from_arrays(pa.array(heads.ravel()), heads.shape[1]).cast(pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*batch.columns, listed, pa.array(curve(heads))], ["h1", "h2", "least", "copies", "vector", "head", "place"])

        return step

    placed = map_arrow(grouped.select("h1", "h2", "least", "copies", "vector"), place, f"h1 long, h2 long, least long, copies long, vector {kind}, head array<double>, place long", rows=4096)
    placed = checkpoint(placed.withColumn("node", F.monotonically_increasing_id()))
    n_tiles = max(1, -(-total_rows(placed) // tile))
    # a run of equal places may overfill a range: what it holds is dealt into tiles of a bounded size by the nodes' hash
    ranged = placed.repartitionByRange(n_tiles, "place", F.xxhash64("node")).withColumn("range", F.spark_partition_id())
    box = [f(F.element_at("head", k + 1)).alias(f"{name}{k}") for k in range(min(BOX_AXES, dims)) for name, f in (("lo", F.min), ("hi", F.max))]
    listed = F.collect_list(F.struct("node", "copies", "vector"))
    tiles = checkpoint(ranged.groupBy(F.col("range").cast("long").alias("tile")).agg(listed.alias("members"), *box))
    packed = tiles.select("tile", F.col("members.node").alias("nodes"), F.col("members.copies").alias("copies"), F.flatten("members.vector").alias("vectors"))
    pairs = near_tiles(tiles.drop("members"), min(BOX_AXES, dims), 2 - 2 * threshold + SLACK)
    found = checkpoint(tile_links(packed, pairs, axes, dims, threshold, n_tiles))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "root")
    own = placed.select("h1", "h2", "node", "least", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = own.groupBy("root").agg(F.min("least").alias("component_id"))
    reps = own.join(named, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = fit.select("id", *digests).join(reps, ["h1", "h2"]).select("id", "n_links", "component_id")
    return finished(linked.unionByName(alone(rows.filter(~fits))), id_col)


def alone(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))


def finished(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
