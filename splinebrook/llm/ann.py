"""Approximate nearest neighbours with learned partitions.

On a bounded sample of the vectors a neighbour graph is built and cut into parts of equal size by recursive spectral
bisection (each half gets the vectors on its side of the median of the graph's second eigenvector). A small classifier
then learns, from a vector, how its neighbours spread over the parts. A part that gets more rows of the table than a leaf
may hold is partitioned again, from a sample of its own, so the parts grow in number with the table and not in size; the
parts of a level are fitted side by side on the cluster. Every row is indexed under its most probable leaf; a query visits
the most probable leaves, and what they hold is ranked by the exact distance.

Tables of every size are partitioned at least once, if there are rows enough to fit a router (two parts of 2 k rows); without a
router all rows are one leaf, and the search is exact.

How many leaves a query visits is measured: for a bounded number of rows the exact neighbours in the whole table are found,
and the fewest leaves that hold the wanted share of them are visited by all queries; as many are put in order as that
takes, all of them if need be. All rows are indexed; leaves are
stored in blocks of a bounded size, so a leaf that can't be cut (a third of all rows may be one vector) is many blocks and
many tasks.

Vectors that are null, empty, zero, of another dimension than the most common one, or that hold null or non-finite
components are neither queries nor candidates, and neither are rows with a null id. With fewer candidates than k a query
gets all of them. Ties go to the smaller id; repeated vectors are candidates of their own. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, draw, map_arrow
from .embed_dedup import matrix, usable

#: Rows of the sample that a router is fitted on, at most.
SAMPLE = 4096
PARTS = 16
#: Rows of a leaf at most, if it can be cut.
LEAF = 16_384
#: Levels of routers: with 16 parts each, numbers of nodes stay below 2^63.
LEVELS = 15
NEIGHBOURS = 10
#: Recall wanted on so many rows whose exact neighbours are found.
RECALL = 0.96
MEASURED = 64
#: Leaves that are put in order at first to find how many a query has to visit.
BEAM = 64
#: Expected rows of a stored block, and queries compared with a block at a time.
BLOCK = 4096
QUERY_BLOCK = 256
SEED = 13


@dataclass
class Router:
    """A softmax classifier with one hidden layer over the parts."""

    mean: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) @ self.w1 + self.b1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x) @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


@dataclass
class Index:
    """Routers by node; the children of node k are k * parts + 1 and so on, and nodes without a router are leaves."""

    parts: int
    routers: dict[int, Router] = field(default_factory=dict)
    probes: int = 1

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The most probable leaf of each vector, level by level."""
        nodes = np.zeros(len(x), dtype=np.int64)
        while True:
            moved = False
            for node in np.unique(nodes).tolist():
                router = self.routers.get(node)
                if router is not None:
                    at = np.flatnonzero(nodes == node)
                    nodes[at] = node * self.parts + 1 + router.probabilities(x[at]).argmax(axis=1)
                    moved = True
            if not moved:
                return nodes

    def ordered(self, x: np.ndarray, most: int, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the `most` probable leaves that hold rows, of each vector, most probable first."""
        row, node, logp = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        while True:
            rows, nodes, logps, split = [], [], [], np.zeros(len(node), dtype=bool)
            for k in np.unique(node).tolist():
                router = self.routers.get(k)
                if router is None:
                    continue
                at = np.flatnonzero(node == k)
                split[at] = True
                p = router.probabilities(x[row[at]])
                rows.append(np.repeat(row[at], p.shape[1]))
                nodes.append(np.tile(k * self.parts + 1 + np.arange(p.shape[1]), len(at)))
                logps.append((logp[at, None] + np.log(np.maximum(p, 1e-300))).ravel())
            if not rows:
                return row, node
            row, node, logp = (np.concatenate([old[~split], *new]) for old, new in ((row, rows), (node, nodes), (logp, logps)))
            held = np.array([n in self.routers or n in sizes for n in node.tolist()])
            order = np.lexsort((node, -logp, row))
            order = order[held[order]]
            row, node, logp = row[order], node[order], logp[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, node, logp = row[rank < most], node[rank < most], logp[rank < most]


def neighbour_lists(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row, itself left out."""
    norms = (x * x).sum(axis=1)
    out = np.empty((len(x), k), dtype=np.int64)
    for start in range(0, len(x), 1024):
        d = norms[None, :] - 2 * x[start : start + 1024] @ x.T
        d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
        out[start : start + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisect(adjacency: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Cut the members at the median of the second eigenvector of their graph, found by power iteration."""
    a = adjacency[np.ix_(members, members)]
    degree = a.sum(axis=1) + 1e-3
    root = np.sqrt(degree)
    top = root / np.linalg.norm(root)
    v = rng.standard_normal(len(members))
    for _ in range(60):
        v -= top * (top @ v)
        v = v + (a @ (v / root)) / root  # I + normalised adjacency: all eigenvalues are positive
        v /= np.linalg.norm(v)
    order = np.argsort(v / root, kind="stable")
    half = len(members) // 2
    return members[order[:half]], members[order[half:]]


def balanced_parts(lists: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    n = len(lists)
    adjacency = np.zeros((n, n), dtype=np.float32)
    adjacency[np.arange(n)[:, None], lists] = 1
    adjacency = np.maximum(adjacency, adjacency.T)
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(adjacency, g, rng)]
    labels = np.empty(n, dtype=np.int64)
    for k, g in enumerate(groups):
        labels[g] = k
    return labels


def train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 64, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4) -> Router:
    """Fit the classifier to soft targets by Adam on mini-batches of the cross entropy."""
    dims, parts = x.shape[1], target.shape[1]
    mean = x.mean(axis=0)
    scale = 1 / max(float((x - mean).std()), 1e-12)
    weights = [rng.standard_normal((dims, hidden)) * scale / np.sqrt(dims), np.zeros(hidden), rng.standard_normal((hidden, parts)) * 0.1, np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            rows = order[lo : lo + 128]
            model = Router(mean, *weights)
            h, p = model.hidden(x[rows]), model.probabilities(x[rows])
            out = (p - target[rows]) / len(rows)
            back = (out @ weights[2].T) * (1 - h * h)
            grads = [(x[rows] - mean).T @ back, back.sum(axis=0), h.T @ out + decay * weights[2], out.sum(axis=0)]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                size = rate * (scale if k == 0 else 1)
                weights[k] = weights[k] - size * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    return Router(mean, *weights)


def fit(sample: np.ndarray, parts: int = PARTS, k: int = NEIGHBOURS, seed: int = SEED) -> Router | None:
    """Partition the neighbour graph of the sample and train the router; None if the sample is too small to be cut."""
    rng = np.random.default_rng(seed)
    n, _ = sample.shape
    while parts > 1 and n < 2 * k * parts:
        parts //= 2
    if parts <= 1:
        return None
    lists = neighbour_lists(sample, k)
    labels = balanced_parts(lists, parts, rng)
    spread = np.zeros((n, parts))
    np.add.at(spread, (np.arange(n)[:, None], labels[lists]), 1.0)
    spread[np.arange(n), labels] += 1
    spread /= spread.sum(axis=1, keepdims=True)
    return train(sample, spread, rng)


def grow(rows: DataFrame, dims: int, n: int, parts: int, leaf: int, k: int, sample: int, seed: int) -> Index:
    """Fit routers, a level of parts at a time, until no part that can be cut holds more than leaf rows. The table is always cut."""
    index, whole = Index(parts), set()
    for _ in range(LEVELS if n else 0):
        placed = located(rows, index, dims)
        counts = {r["node"]: r["n"] for r in placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}  # about n / leaf nodes
        for node, count in counts.items():  # a part that got all the rows of its parent can't be cut
            parent = (node - 1) // parts
            if node and count >= 0.98 * sum(counts.get(parent * parts + 1 + c, 0) for c in range(parts)):
                whole.add(node)
        large = {node: count for node, count in counts.items() if (count > leaf or node == 0) and node not in whole and node not in index.routers}
        if not large:
            break
        bounds = [(node, int(-(1 << 63) + (1 << 64) * min(1 - 2**-50, 1.5 * sample / count))) for node, count in large.items()]
        bound = rows.sparkSession.createDataFrame(bounds, "node long, bound long")
        drawn = placed.withColumn("draw", F.xxhash64("id", F.lit(seed))).join(F.broadcast(bound), "node").filter("draw < bound")
        place = F.row_number().over(Window.partitionBy("node").orderBy("draw", "id"))
        drawn = drawn.withColumn("place", place).filter(F.col("place") <= sample).select("node", "draw", "id", "vector")

        def fitted(table: pa.Table) -> pa.Table:
            table = table.sort_by([("draw", "ascending"), ("id", "ascending")])
            router = fit(matrix(table["vector"].combine_chunks(), dims), parts, k, seed)
            return pa.table({"node": table["node"][:1], "router": pa.array([pickle.dumps(router)], pa.binary())})

        for r in drawn.groupBy("node").applyInArrow(fitted, "node long, router binary").collect():
            router = pickle.loads(r["router"])
            if router is None:
                whole.add(r["node"])
            else:
                index.routers[r["node"]] = router
    return index


def located(rows: DataFrame, index: Index, dims: int) -> DataFrame:
    """Rows (id, node, vector): the leaf of each."""
    held = rows.sparkSession.sparkContext.broadcast(index)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.homes(matrix(batch.column(1), dims))), batch.column(1)], ["id", "node", "vector"])

        return step

    return map_arrow(rows.select("id", "vector"), make, "id long, node long, vector array<double>", rows=4096)


def measured_probes(rows: DataFrame, placed: DataFrame, index: Index, sizes: dict[int, int], dims: int, k: int, recall: float, seed: int) -> int:
    """The fewest leaves that hold the wanted share of the exact neighbours of MEASURED rows."""
    asked = draw(rows.select("id", "vector"), MEASURED, F.col("id"), seed + 1).select("id", "vector").toArrow().combine_chunks()
    ids, x = asked["id"].to_numpy(), matrix(asked["vector"].combine_chunks(), dims)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = np.asarray(batch.column(0))
            q, i, d = nearest(x, ids, matrix(batch.column(2), dims), own, k)
            order = np.argsort(own, kind="stable")
            leaf = np.asarray(batch.column(1))[order[np.searchsorted(own[order], i)]] if len(i) else np.zeros(0)
            return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(leaf.astype(np.int64)), pa.array(d.astype(float))], ["q", "i", "leaf", "d"])

        return step

    near = map_arrow(placed.select("id", "node", "vector"), make, "q long, i long, leaf long, d double", rows=4096)
    first = Window.partitionBy("q").orderBy("d", "i")
    found = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("q", "leaf").collect()  # MEASURED * k
    beam = BEAM
    while found:
        row, leaf = index.ordered(x, beam, sizes)
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        place = {(int(ids[r]), int(n)): int(p) for r, n, p in zip(row, leaf, rank, strict=True)}
        ranks = np.array([place.get((r["q"], r["leaf"]), len(sizes)) for r in found])
        enough = next((p for p in range(1, min(beam, len(sizes)) + 1) if (ranks < p).mean() >= recall), None)
        if enough is not None:
            return enough
        beam *= 2  # with all leaves in order nothing is missed
    return 1


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance) of the k nearest candidates of each query in a block, itself left out."""
    out_q, out_i, out_d = [], [], []
    close = (queries * queries).sum(axis=1)[:, None] + (vectors * vectors).sum(axis=1)[None, :] - 2 * queries @ vectors.T
    scale = 1e-9 * (1 + np.abs(close).max()) if close.size else 0
    for r in range(len(queries)):
        d = close[r]
        own = ids == query_ids[r]
        d[own] = np.inf
        some = np.flatnonzero(~own)
        if len(some) > k:  # the k nearest by the fast form, and all that rounding could put among them
            some = np.flatnonzero((d <= np.partition(d, k - 1)[k - 1] + scale) & ~own)
        exact = np.sqrt(((vectors[some] - queries[r]) ** 2).sum(axis=1))
        order = np.lexsort((ids[some], exact))[:k]
        out_q.append(np.full(len(order), query_ids[r]))
        out_i.append(ids[some][order])
        out_d.append(exact[order])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_i, out_d))


def visits(rows: DataFrame, index: Index, dims: int, sizes: dict[int, int], k: int) -> DataFrame:
    """Rows (id, node, vector): the leaves that each query has to visit; more of them while they hold too few candidates."""
    held = rows.sparkSession.sparkContext.broadcast((index, sizes))

    def make():
        index, sizes = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, leaf = index.ordered(matrix(batch.column(1), dims), max(index.probes, k + 2), sizes)
            size = np.array([sizes.get(n, 0) for n in leaf.tolist()])
            first = np.searchsorted(row, row)
            before = np.cumsum(size) - size
            visit = (np.arange(len(row)) - first < index.probes) | (before - before[first] <= k)
            at = pa.array(row[visit])
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(leaf[visit]), batch.column(1).take(at)], ["id", "node", "vector"])

        return step

    return map_arrow(rows.select("id", "vector"), make, "id long, node long, vector array<double>", rows=1024)


def search(df: DataFrame, is_query: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, parts: int = PARTS, recall: float = RECALL, sample: int = SAMPLE, seed: int = SEED, leaf: int = LEAF) -> DataFrame:
    """Rows (query_id, rank, id, score): the k nearest of df that were found for each row with is_query."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.filter(usable("vector") & F.col("id").isNotNull())
    common = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dims, n = (int(common["d"]), int(common["n"])) if common else (1, 0)
    rows = rows.filter(F.size("vector") == dims)
    index = grow(rows, dims, n, parts, leaf, k, sample, seed)
    placed = checkpoint(located(rows, index, dims))
    counted = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    counted = checkpoint(counted)
    sizes = {r["node"]: r["n"] for r in counted.collect()}  # about n / leaf numbers
    if index.routers:
        index.probes = measured_probes(rows, placed, index, sizes, dims, k, recall, seed)
    stored = placed.join(F.broadcast(counted), "node").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    stored = stored.groupBy("node", "block").agg(F.collect_list(F.struct("id", "vector")).alias("m"))
    stored = stored.select("node", "block", F.col("m.id").alias("ids"), F.flatten("m.vector").alias("vectors"))
    asked = visits(rows.filter("query"), index, dims, sizes, k)
    heaps = asked.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("heaps")).join(counted, "node")
    asked = asked.join(F.broadcast(heaps), "node").withColumn("heap", F.pmod(F.xxhash64("id"), F.col("heaps")))
    asked = asked.groupBy("node", "heap", "blocks").agg(F.collect_list(F.struct("id", "vector")).alias("m"))
    asked = asked.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("m.id").alias("query_ids"), F.flatten("m.vector").alias("queries"))
    met = asked.join(stored, ["node", "block"]).select("query_ids", "queries", "ids", "vectors")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = []
            for r in range(batch.num_rows):
                q_ids, q, ids, v = (np.asarray(batch.column(c)[r].values) for c in range(4))
                found.append(nearest(q.reshape(-1, dims), q_ids, v.reshape(-1, dims), ids, k))
            q, i, d = (np.concatenate([f[c] for f in found]) for c in range(3))
            return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(d)], ["query_id", "id", "score"])

        return step

    near = map_arrow(met, make, "query_id long, id long, score double", rows=1)
    first = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
