"""SimHash near-duplicates: fingerprints, and links within a Hamming radius by bit-sliced comparison.

A fingerprint bit is 1 if it is set in more than half of the hashes of the document's word shingles. Equal fingerprints
are collapsed first. For a radius r the 64 bits are cut into r + 2 blocks, so two fingerprints within the radius agree on
two blocks at least: the values of each two blocks are a bucket key (26 bits for a radius of 3, so that 10^10 fingerprints
fill buckets of hundreds), and what agrees on a key is compared in tiles of a bounded size. A tile's fingerprints are stored
as 64 vertical bit planes (one bit of every fingerprint in a row of machine words); a query's distances to all of them are
counted at once by carry-save adders, and a block of words is abandoned as soon as all its counters exceed the radius. Only
a spanning star of what links is kept, never all pairs.

Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows share a fingerprint. Texts are
read whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow
from .components import connected, local_roots

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints of a tile.
TILE = 4096
#: Shingle hashes whose bits are spread out at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text: lower-cased A-Z, words without ASCII white space, hashed word shingles, majority bits."""
    words = (text or "").encode().translate(LOWER).split()  # bytes split at just the six ASCII white-space bytes
    return majority(shingle_hashes(words, shingle, seed))


def shingle_hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words joined by one space; of all words where they are fewer; none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    count = max(1, len(words) - shingle + 1)
    starts = [0, *ends][:count]
    stops = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def text_key(text_col: str = "text") -> Column:
    """A hash that tells the texts of rows of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Rows (id, key long, fp long), one per row of df; fp holds the 64 bits as a signed number, key is a hash of the text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["id", "key", "fp"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, make, f"id {kind}, key long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows; bit j of row i (in words of 64) is bit i of fingerprint j. The last word is padded."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, sliced: np.ndarray, radius: int) -> np.ndarray:
    """Boolean (queries, fingerprints): whether the Hamming distance is at most radius (1 to 3, or more by more counters).

    Counters are vertical too: `counter[k]` holds bit k of every distance, saturating above the radius.
    """
    n_counters = int(radius).bit_length()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    over = np.zeros((len(queries), sliced.shape[1]), dtype=np.uint64)  # 1: beyond the counters, for good
    counter = [np.zeros_like(over) for _ in range(n_counters)]
    live = np.arange(len(queries))
    for bit in range(64):
        flip = np.where((queries[live] >> np.uint64(bit)) & np.uint64(1), full, np.uint64(0))
        carry = sliced[bit][None, :] ^ flip[:, None]
        for k in range(n_counters):
            carry, counter[k][:] = counter[k] & carry, counter[k] ^ carry
        over |= carry
        if bit % 8 == 7 and bit > 15:
            keep = (over != full).any(axis=1)  # abandon queries that are too far from the whole block
            if not keep.all():
                if not keep.any():
                    return np.zeros((len(queries), sliced.shape[1] * 64), dtype=bool)
                live, over, counter = live[keep], over[keep], [c[keep] for c in counter]
    if radius != (1 << n_counters) - 1:
        over |= above(counter, radius)
    hits = np.zeros((len(queries), sliced.shape[1] * 64), dtype=bool)
    hits[live] = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little").astype(bool)
    return hits


def above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the vertical number is greater than radius."""
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def linked(left: np.ndarray, right: np.ndarray, radius: int, queries: int = 64, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into left, into right) within the radius; a block of queries against a block of planes at a time."""
    for b in range(0, len(right), block):
        sliced = planes(right[b : b + block])
        n = len(right[b : b + block])
        for a in range(0, len(left), queries):
            x, y = np.nonzero(within(left[a : a + queries], sliced, radius)[:, :n])
            if len(x):
                yield x + a, y + b


def star(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints as a star: each but the local root, with the root."""
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    roots = local_roots(len(nodes), index[: len(left)], index[len(left) :])
    off = roots != np.arange(len(nodes))
    return nodes[off], nodes[roots[off]]


def bucket_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(run number, fingerprints, side) of whole runs of equal keys, several small runs together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(c)) for c in range(3)]
        change = np.ones(batch.num_rows, dtype=bool)
        change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        if held:
            tail = held[-1]
            change[0] = any(tail.column(c)[tail.num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in range(3))
        starts = np.flatnonzero(change)
        if not len(starts):
            held.append(batch)
            continue
        if starts[-1] or held:
            yield numbered([*held, batch.slice(0, starts[-1])])
        held = [batch.slice(starts[-1])]
    if held:
        yield numbered(held)


def numbered(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    columns = [np.concatenate([np.asarray(p.column(c)) for p in parts]) for c in range(5)]
    change = np.ones(len(columns[0]), dtype=bool)
    change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in columns[:3]])
    return np.cumsum(change) - 1, columns[4].view(np.uint64), columns[3]


#: A run of fewer fingerprints is compared together with others, shifted against themselves.
SMALL_RUN = 48


def compare(run: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run (side 2), or between its left (0) and right (1) tile, as stars."""
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    small = (sizes < SMALL_RUN)[run] & (side == 2)
    some, own = fps[small], run[small]
    for shift in range(1, SMALL_RUN):
        same = np.flatnonzero(own[shift:] == own[:-shift]) if shift < len(own) else np.zeros(0, int)
        if not len(same):
            break
        hit = close(some[same] ^ some[same + shift], radius)
        left.append(some[same][hit])
        right.append(some[same + shift][hit])
    for start, size in zip(starts, sizes, strict=True):
        if small[start]:
            continue
        part, at = fps[start : start + size], side[start : start + size]
        a, b = (np.arange(size),) * 2 if at[0] == 2 else (np.flatnonzero(at == 0), np.flatnonzero(at == 1))
        roots = np.arange(size)
        for x, y in linked(part[a], part[b], radius):
            roots = local_roots(size, roots[a[x]], roots[b[y]])[roots]
        left.append(part)
        right.append(part[roots])
    return star(np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def close(differing: np.ndarray, radius: int) -> np.ndarray:
    """Which of these 64-bit differences have at most radius bits: one vertical count over all of them."""
    return within(np.zeros(1, dtype=np.uint64), planes(differing), radius)[0, : len(differing)]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows (a, b): stars of fingerprints that link in a bucket or a pair of its tiles; joined up, they give all components.

    distinct: one column fp. Buckets of more than `tile` fingerprints are cut into tiles, and the tiles of a bucket are
    compared pair by pair, each pair a unit of work of its own, so that no bucket meets in one task.
    """
    cuts = np.linspace(0, 64, radius + 3).astype(int)
    values = [F.shiftrightunsigned("fp", int(lo)).bitwiseAND(F.lit((1 << int(hi - lo)) - 1)) for lo, hi in itertools.pairwise(cuts)]
    widths = np.diff(cuts).tolist()
    both = [(F.shiftleft(values[i], widths[j]) + values[j]) for i, j in itertools.combinations(range(len(values)), 2)]
    keys = F.array(*[F.struct(F.lit(k).alias("block"), value.alias("value")) for k, value in enumerate(both)])
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.block", "key.value")
    sizes = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiled = keyed.join(sizes, ["block", "value"]).withColumn("tiles", F.ceil(F.col("n") / tile)).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    pairs = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    side = F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1)
    unit = pairs.select((F.col("block") * (1 << 48) + F.col("value")).alias("bucket"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), side.cast("long").alias("side"), "fp")
    dealt = unit.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches):
        for number, fps, at in bucket_runs(batches):
            a, b = compare(number, fps, at, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def rooted(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """Rows (fp, least), one for each fingerprint: the first row of its component as (without, id, key), null ids last."""
    row = F.struct(F.col("id").isNull().alias("without"), "id", "key")
    of_fp = prints.groupBy("fp").agg(F.min(row).alias("own"))
    roots = connected(links(of_fp.select("fp"), radius, tile))
    grouped = of_fp.join(roots, of_fp.fp == roots.node, "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("own").alias("least"))
    return grouped.select("fp", "root").join(least, "root").select("fp", "least")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """Rows (id, fp, component_id), one per row of df; component_id is the smallest id reachable by links, itself included.

    Ids should be unique; rows of one id each get a row, and a null id can't be the smallest.
    """
    prints = checkpoint(fingerprints(df, id_col, text_col, shingle, seed))
    return prints.join(rooted(prints, radius, tile), "fp").select("id", "fp", F.col("least.id").alias("component_id")).withColumnRenamed("id", id_col)


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """Rows (id, key, n, stays) for the ids and texts of which a row has to go; key is the text's text_key.

    Each row counts by its own component, whatever other rows share its id. The row that stays of a component is that of the
    smallest id (null ids last) and then key; n > 1 rows with that id and text are copies of one another.
    """
    prints = checkpoint(fingerprints(df, id_col, text_col, shingle, seed))
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key"))
    marked = prints.join(rooted(prints, radius, tile), "fp").select("id", "key", first.alias("stays"))
    found = marked.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"), F.max("stays").alias("stays"))
    return found.filter("n > 1 OR NOT stays").withColumnRenamed("id", id_col)
