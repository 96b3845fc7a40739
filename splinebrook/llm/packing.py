"""Packing documents into sequences by first-fit decreasing, with a tournament tree of bin capacities.

Every document is its token ids and one closing id, cut into full pieces of the sequence length and a rest. Pieces are
dealt at random (by a hash of their row number in the materialised table) into groups of a bounded expected size, and
each group is packed on its own: longest piece first, each into the first open bin with room. The tournament tree has
the bins as leaves and the larger of two capacities at each inner node, so the first bin with room is found by going
down from the root, left where the left side has room.

Full pieces fill a sequence each and take no part in the search. Null and empty texts are the closing id alone.
Repeated rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_vocab, encoder
from .common import checkpoint, map_arrow, total_rows

SEQUENCE = 2048
CLOSING_ID = 1
#: Expected pieces of a group.
GROUP_PIECES = 8192
SEED = 7


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, length: int = SEQUENCE, closing_id: int = CLOSING_ID) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens), one per piece."""
    path = vocab_path or default_vocab()
    closing = np.array([closing_id], dtype="<u4").tobytes()

    def make():
        enc = encoder(path, trie=False)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for k, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                ids += closing
                total = len(ids) // 4
                for start in range(0, total, length):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append(k)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(total)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, make, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the given order; every length lies in 1..capacity."""
    leaves = 1
    while leaves < max(len(lengths), 1):
        leaves *= 2
    tree = [capacity] * (2 * leaves)  # tree[1] is the root; an unopened bin has full capacity
    bins, offsets = [], []
    for size in lengths.tolist():
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - tree[node])
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return np.array(bins, dtype=np.int64), np.array(offsets, dtype=np.int64)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, length: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = SEED) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece."""
    numbered = checkpoint(pieces(df, id_col, text_col, vocab_path, length)).withColumn("row", F.monotonically_increasing_id())
    full = numbered.filter(F.col("length") == length)
    rest = numbered.filter(F.col("length") < length)
    groups = max(1, -(-total_rows(rest) // group_pieces))
    kind = numbered.schema["id"].dataType.simpleString()
    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def pack_group(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins, offsets = first_fit(group["length"].to_numpy(), length)
        group["sequence_id"] = key[0] * (1 << 32) + bins
        group["offset"] = offsets
        return group[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    grouped = rest.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))
    packed = grouped.groupBy("group").applyInPandas(pack_group, out)
    # sequences of their own get negative ids, which no group uses
    alone = full.select("id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone).withColumnRenamed("id", id_col)
