"""Words and runs of words of whole texts as Arrow columns, and filters that tell which of them can matter.

Texts are gathered into chunks of about CHUNK_BYTES, so that a task's memory is bounded whatever it reads, and each chunk is
cut, numbered and counted column by column. Counts leave a chunk summed up, once for each different run of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_BITS, MEMBER_BITS, MOST_BITS, total_rows

CHUNK_BYTES = 4 << 20
#: What ends a piece or a text. No word has it.
END = b"\n"
#: Odd multipliers that mix the hash of a run of words with that of the next word.
MIX, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
#: Bits that Spark's bitmap aggregates put in one row.
BITMAP_BITS = 8 * 4096


def numbered(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The different tokens of data, which has spaces between them, and the number of each token in order."""
    tokens = pc.split_pattern(pa.array([data], pa.large_binary()), " ").flatten().dictionary_encode()
    codes = tokens.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(tokens.dictionary, pa.scalar(b"", pa.large_binary())).as_py()
    return tokens.dictionary, codes if empty < 0 else codes[codes != empty]


def is_word(tokens: pa.Array) -> np.ndarray:
    """For each different token, whether it is a word: neither empty nor an end."""
    found = pc.binary_length(tokens).to_numpy(zero_copy_only=False) > 0
    end = pc.index(tokens, pa.scalar(END, tokens.type)).as_py()
    if end >= 0:
        found[end] = False
    return found


def windows(data: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """data cut after ends, into windows of about `size` bytes; what has no end stays whole."""
    at = 0
    while at < len(data):
        cut = data.find(END, at + size)
        cut = len(data) if cut < 0 else cut + 1
        yield data[at:cut]
        at = cut


def strings(tokens: pa.Array) -> pa.Array:
    return tokens.cast(pa.large_string()).cast(pa.string())


def word_hashes(tokens: pa.Array, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t, seed) for t in tokens.to_pylist()], dtype=np.uint64)


def chained(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of runs of words with one more word at their end."""
    h = before * MIX + last
    return (h ^ (h >> np.uint64(29))) * FINAL


def run_hash(group: str, run: str) -> int:
    """The hash of a run of words, words joined by one space, in a group (a language)."""
    seed = xxhash.xxh64_intdigest(group.encode())
    parts = np.array([xxhash.xxh64_intdigest(w, seed) for w in run.encode().split(b" ")], dtype=np.uint64)
    h = parts[:1]
    for k in range(1, len(parts)):
        h = chained(h, parts[k : k + 1])
    return int(h[0])


class Members:
    """A bit filter: `has` is true for all members' hashes and for few others."""

    def __init__(self, bits: int, filled: list[tuple[int, bytes]]):
        self.mask = np.uint64(bits - 1)
        self.bytes = np.zeros(bits // 8, dtype=np.uint8)
        for part, found in filled:
            here = np.frombuffer(found, dtype=np.uint8)[: bits // 8]
            self.bytes[part * (BITMAP_BITS // 8) : part * (BITMAP_BITS // 8) + len(here)] = here

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & self.mask).astype(np.int64)
        return (self.bytes[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def members(runs: DataFrame) -> Broadcast:
    """A filter of the rows (group, run) of `runs`, with 16 bits for each and 32 MB at most: beyond that it lets more through,
    which the exact counts behind it settle. Runs is read twice."""
    spark = runs.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (MEMBER_BITS * total_rows(runs)).bit_length()))

    def slots(batches):
        for b in batches:
            found = [run_hash(g, r) & (bits - 1) for g, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([s + 1 for s in found], pa.int64())], ["slot"])

    at = runs.mapInArrow(slots, "slot long")
    parts = at.groupBy((F.bitmap_bucket_number("slot") - 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    return spark.sparkContext.broadcast(Members(bits, [(r[0], bytes(r[1])) for r in parts.collect()]))


def joined(columns: list[pa.Array]) -> pa.Array:
    """The words of several columns joined by one space, row by row."""
    return pc.binary_join_element_wise(*columns, pa.scalar(" ")) if len(columns) > 1 else columns[0]


def summed(columns: list[np.ndarray], weights: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each different row of `columns` (numbers below `base`) stands first, and the sum of its weights."""
    key = columns[0].astype(np.int64)
    for k, column in enumerate(columns[1:], 1):
        if k > 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * base + column
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first, np.bincount(inverse, weights=weights, minlength=len(first)).astype(np.int64)
