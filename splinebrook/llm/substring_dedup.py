"""Removal of repeated passages with a log-structured fingerprint index.

A window is a run of `window` consecutive words. Its fingerprint is the least hash of the word n-grams in it, so windows
of equal words have equal fingerprints; neighbouring windows mostly share theirs, and such a run of windows is one block:
one row of the occurrence table (fingerprint, 128-bit hash of the block's words, document, first window, windows).

`FingerprintIndex` lives in a folder and can be opened again. It holds for each fingerprint how many blocks carry it and
the least and greatest block hashes. Each batch of documents makes one run of it: an immutable table, bucketed and sorted by
fingerprint. Runs of one level are merge-joined, bucket by bucket and without a shuffle, into one of the next level
(compaction), so that a fingerprint is rewritten about log(batches) times. A new batch is looked up in all runs; `dedupe`
returns rows for its documents, and for those older ones that it repeats. Fed batch after batch, the last row of each
document is what one call over all documents gives.

A fingerprint seen once is no repeat. Where all blocks of a repeated fingerprint have the same words, all its windows
repeat. The rest is verified window by window: one representative of each different block is read again and its windows
are counted by their words. Copies therefore collapse into one block before any window is looked at. Equal words are
told by 128-bit hashes: among 10^12 windows of different words two are taken for equal with a chance of 10^-15.

Null texts have no words. Texts of fewer words than a window, and whatever repeats nowhere, stay as they are. Repeated
rows repeat each other. An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, delete, exists, map_arrow, maybe_in, names_in, scratch_path

WINDOW = 35
GRAM = 8
BATCHES = 2
#: Runs of a level that are compacted into one of the next.
RUNS = 2
#: Folders that the index deals its texts into.
FOLDERS = 64

digest = xxhash.xxh64_intdigest
words_digest = xxhash.xxh3_128_digest


def words_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit hashes of these words."""
    found = np.frombuffer(b"".join([words_digest(p) for p in parts]), dtype=">i8").astype(np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def word_list(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8: bytes split at just these six."""
    return text.encode().split() if text else []


def layout(words: list[bytes]) -> tuple[bytes, list[int], list[int]]:
    """The words joined by one space, and where each starts and ends there."""
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    return b" ".join(words), [0, *[e + 1 for e in ends[:-1]]], ends


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def blocks(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Fingerprint, both halves of the block hash, first window, windows, and whether a window may repeat inside, by block."""
    if len(words) < window:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    joined, starts, ends = layout(words)
    grams = np.array([digest(joined[a:b]) for a, b in zip(starts, ends[gram - 1 :])], dtype=np.uint64).view(np.int64)
    width = window - gram + 1
    least = sliding_min(grams, width)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(least)]])
    high, low = words_hashes([joined[starts[a] : ends[b + window - 2]] for a, b in zip(first.tolist(), last.tolist())])
    inside = np.zeros(len(first), dtype=np.int64)
    ordered = np.sort(grams)
    if (ordered[1:] == ordered[:-1]).any():
        for k, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
            inside[k] = b - a > 1 and np.count_nonzero(grams[a : b - 1 + width] == least[a]) > 1
    return least[first], high, low, first, last - first, inside


def keyed(df: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """Columns id, mark (a hash of the text, for repeated ids), text, and the extra ones numbered x0, x1, ..."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(extra)])


def occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (fp, high, low, id, mark, start, n, inside): one per block of each document."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [blocks(word_list(t), window, gram) for t in batch.column(2).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            fp, high, low, start, n, inside = (pa.array(np.concatenate([f[k] for f in found])) for k in range(6))
            return pa.RecordBatch.from_arrays([fp, high, low, batch.column(0).take(rows), batch.column(1).take(rows), start, n, inside], ["fp", "high", "low", "id", "mark", "start", "n", "inside"])

        return step

    return map_arrow(docs.select("id", "mark", "text"), make, occurrence_schema(docs.schema["id"].dataType.simpleString()))


def occurrence_schema(kind: str) -> str:
    return f"fp long, high long, low long, id {kind}, mark long, start long, n long, inside long"


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, the occurrences behind them and the texts, under one shared folder.

    Without texts (keep_texts=False) documents can be added and resolved against the tables they came from, but later
    batches can't be deduplicated against them.
    """

    COUNTS = (("n_blocks", F.sum), ("least_high", F.min), ("greatest_high", F.max), ("least_low", F.min), ("greatest_low", F.max), ("inside", F.max))
    COLUMNS = ("fp", *(name for name, _ in COUNTS))

    def __init__(self, spark: SparkSession, root: str, kind: str = "bigint", window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, keep_texts: bool = True):
        self.spark, self.root, self.kind, self.window, self.gram, self.keep_texts = spark, root, kind, window, gram, keep_texts
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[dict] = []  # {"name", "level"}, oldest first
        self.gone: list[dict] = []  # runs that have been merged into others, but may still be in the manifest in force
        self.batches = self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str, **new) -> FingerprintIndex:
        """The index in this folder, or a new one there."""
        version = max(cls.versions(spark, root), default=0)
        if not version:
            return cls(spark, root, **new)
        state = json.loads(spark.read.text(f"{root}/manifests/{version:08d}", wholetext=True).first()[0])
        index = cls(spark, root, state["kind"], state["window"], state["gram"], state["buckets"], state["keep_texts"])
        index.runs, index.batches, index.version = state["runs"], state["batches"], version
        for run in index.runs:
            if not exists(spark, f"{root}/{run['name']}/_SUCCESS"):
                raise FileNotFoundError(f"manifest {version} of {root} names {run['name']}, which is not there")
            columns = ", ".join(f"{c} bigint" for c in cls.COLUMNS)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {run['name']} ({columns}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {index.buckets} BUCKETS LOCATION '{root}/{run['name']}'")
        return index

    @staticmethod
    def versions(spark: SparkSession, root: str) -> list[int]:
        """The manifests that were written whole."""
        return [int(v) for v in names_in(spark, f"{root}/manifests") if v.isdigit() and exists(spark, f"{root}/manifests/{v}/_SUCCESS")]

    def save(self) -> None:
        """Write down, under a new version, which runs and batches there are: with that, and not before, the batch counts. Then
        drop the runs that no manifest in force names, and the manifests before this one."""
        state = {k: getattr(self, k) for k in ("kind", "window", "gram", "buckets", "keep_texts", "runs", "batches")}
        version = self.version + 1
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifests/{version:08d}")
        self.version = version
        self.drop_gone()
        for old in names_in(self.spark, f"{self.root}/manifests"):
            if old.isdigit() and int(old) < version:
                delete(self.spark, f"{self.root}/manifests/{old}")

    def drop_gone(self) -> None:
        for run in self.gone:
            self.drop(run)
        self.gone = []

    def write(self, run: DataFrame, level: int) -> dict:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        run.select(*self.COLUMNS).write.format("parquet").bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.root}/{name}").saveAsTable(name)
        return {"name": name, "level": level}

    def drop(self, run: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")
        delete(self.spark, f"{self.root}/{run['name']}")

    def merged(self, runs: list[dict]) -> DataFrame:
        """All fingerprints of these runs with their counts, by merge joins of sorted buckets."""
        out = self.spark.table(runs[0]["name"])
        for run in runs[1:]:
            old, new = out.alias("o"), self.spark.table(run["name"]).alias("n").hint("merge")
            both = {F.sum: lambda a, b: F.coalesce(a, F.lit(0).cast("long")) + F.coalesce(b, F.lit(0).cast("long")), F.min: F.least, F.max: F.greatest}
            out = old.join(new, "fp", "full_outer").select("fp", *[both[how](F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c, how in self.COUNTS])
        return out

    def add(self, docs: DataFrame) -> dict:
        """Add a batch, keyed(...) documents: write its occurrences (and texts) and its run. Returns the run."""
        at = f"{self.root}/occurrences/batch={self.batches}"
        occurrences(docs, self.window, self.gram).write.mode("overwrite").parquet(at)
        if self.keep_texts:
            texts = docs.select("id", "mark", "text").withColumn("folder", F.pmod("mark", F.lit(FOLDERS)))
            texts.repartition(FOLDERS, "folder", F.xxhash64("id")).write.mode("overwrite").partitionBy("folder").parquet(f"{self.root}/texts/batch={self.batches}")
        found = self.occurrences().filter(F.col("batch") == self.batches)
        counts = {"n_blocks": F.count(F.lit(1)), "least_high": F.min("high"), "greatest_high": F.max("high"), "least_low": F.min("low"), "greatest_low": F.max("low"), "inside": F.max("inside")}
        run = self.write(found.groupBy("fp").agg(*[c.alias(name) for name, c in counts.items()]), 0)
        self.runs.append(run)
        self.batches += 1
        return run

    def compact(self) -> None:
        """Merge runs until no level has RUNS of them. What was merged stays until drop_gone."""
        while True:
            levels = Counter(run["level"] for run in self.runs)
            full = min((level for level, n in levels.items() if n >= RUNS), default=None)
            if full is None:
                return
            some = [run for run in self.runs if run["level"] == full]
            compacted = self.write(self.merged(some), full + 1)
            self.runs = [compacted if run is some[0] else run for run in self.runs if run is some[0] or run not in some]
            self.gone += some

    def occurrences(self) -> DataFrame:
        return self.spark.read.schema(f"{occurrence_schema(self.kind)}, batch int").parquet(f"{self.root}/occurrences")

    def texts(self, marks: DataFrame) -> DataFrame:
        """(id, mark, text) of the stored documents whose mark may be among these; other folders are not read."""
        some = [r[0] for r in marks.select(F.pmod("mark", F.lit(FOLDERS)).cast("int")).distinct().collect()]  # FOLDERS at most
        stored = self.spark.read.schema(f"id {self.kind}, mark long, text string, batch int, folder int").parquet(f"{self.root}/texts").filter(F.col("folder").isin(some))
        return maybe_in(stored.select("id", "mark", "text"), "mark", marks).filter("hit").drop("hit")

    def repeated(self, among: DataFrame | None = None) -> DataFrame:
        """Rows (fp, mixed) of fingerprints (of these, if given) that can stand for a repeated window; mixed: blocks differ."""
        mixed = (F.col("least_high") != F.col("greatest_high")) | (F.col("least_low") != F.col("greatest_low")) | (F.col("inside") > 0)
        if len(self.runs) == 1:
            # read as plain files: both sides of a join are then shuffled, and Spark can split a very common fingerprint
            schema = ", ".join(f"{c} long" for c in self.COLUMNS)
            found = self.spark.read.schema(schema).parquet(f"{self.root}/{self.runs[0]['name']}")
        else:
            found = self.merged(self.runs)
        found = found.filter("n_blocks > 1 OR inside > 0").select("fp", mixed.alias("mixed"))
        return found if among is None else found.join(among.select("fp").distinct(), "fp", "left_semi")

    def resolve(self, repeated: DataFrame, sources: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows (id, mark, spans): what repeats in each document, of the given fingerprints' blocks.

        sources: the documents (id, mark, text) whose mark may be among the given ones.
        """
        scratch = f"{self.root}/resolve-{uuid.uuid4().hex}"

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{scratch}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{scratch}/{name}")

        hits = maybe_in(self.occurrences(), "fp", repeated.select("fp")).filter("hit").join(repeated, "fp")
        hits = kept(hits.select("fp", "high", "low", "id", "mark", "start", "n", "mixed"), "hits")
        # blocks of fingerprints whose blocks differ: those that repeat as a whole, and one representative of each
        different = hits.filter("mixed").groupBy("fp", "high", "low").agg(F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("id", "mark", "start", "n"), F.xxhash64("id", "mark", "start")).alias("r"))
        different = kept(different, "different")
        parts = different.select("r.id", "r.mark", F.struct("fp", "high", "low", "r.start", "r.n").alias("part")).groupBy("id", "mark").agg(F.collect_list("part").alias("parts"))
        read_again = sources(parts.select("mark")).dropDuplicates(["id", "mark"])
        picked = read_again.join(parts, (read_again.id.eqNullSafe(parts.id)) & (read_again.mark == parts.mark)).select("text", "parts")
        windows = kept(window_hashes(picked, self.window), "windows")
        # windows that occur once; counting brings no common window's rows together in one place
        counted = windows.groupBy("fp", "word_high", "word_low").agg(F.count(F.lit(1)).alias("k"), F.min("high").alias("high"), F.min("low").alias("low"), F.min("offset").alias("offset"))
        once = counted.filter("k = 1").groupBy("fp", "high", "low").agg(F.collect_list("offset").alias("once"))

        whole = hits.filter("NOT mixed").select("id", "mark", "start", "n", F.lit(None).cast("array<bigint>").alias("offsets"))
        none = F.array().cast("array<bigint>")
        repeats = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.coalesce("once", none))
        verdicts = different.select("fp", "high", "low", "copies", "r.n").join(once, ["fp", "high", "low"], "left").select("fp", "high", "low", F.when(F.col("copies") == 1, repeats).alias("offsets"))
        verdicts = verdicts.filter("offsets IS NULL OR size(offsets) > 0")
        partly = hits.filter("mixed").join(verdicts, ["fp", "high", "low"]).select("id", "mark", "start", "n", "offsets")
        spans = whole.unionByName(partly).groupBy("id", "mark").agg(F.collect_set(F.struct("start", "n", "offsets")).alias("spans"))
        spans = checkpoint(spans)
        delete(self.spark, scratch)
        return spans

    def dedupe(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch of documents; rows (id, n_words, n_removed, kept) for all of it and for the older ones it repeats.

        Of older documents the index reads the occurrences' columns, and the texts that the batch hits. A batch that failed
        half-way, at whatever step, is not there when the index is opened again, and is added anew.
        """
        docs = keyed(df, id_col, text_col, [])
        run = self.add(docs)
        older, own = self.occurrences().filter(F.col("batch") < self.batches - 1), self.occurrences().filter(F.col("batch") == self.batches - 1)
        shared = self.repeated(self.spark.table(run["name"]))
        hit = checkpoint(maybe_in(older, "fp", shared.select("fp")).filter("hit").join(shared, "fp", "left_semi").select("id", "mark").distinct())
        # all that these documents repeat, of old
        theirs = maybe_in(older, "mark", hit.select("mark")).filter("hit").alias("o").join(hit.alias("h"), F.expr("o.id <=> h.id AND o.mark = h.mark"), "left_semi")
        among = checkpoint(own.select("fp").unionByName(theirs.select("fp")).distinct())
        spans = self.resolve(self.repeated(among), self.texts)
        old_texts = self.texts(hit.select("mark")).alias("t").join(hit.alias("h"), F.expr("t.id <=> h.id AND t.mark = h.mark"), "left_semi").dropDuplicates(["id", "mark"])
        new = docs.select("id", "mark", "text")
        # an older document of the same id and text is the same row again: it gets its row with the batch
        old_texts = old_texts.alias("t").join(new.select("id", "mark").alias("d"), F.expr("t.id <=> d.id AND t.mark = d.mark"), "left_anti")
        out = checkpoint(stripped(new.unionByName(old_texts.select("id", "mark", "text")), spans, self.window, ()))
        self.compact()
        self.save()
        return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")


def window_hashes(picked: DataFrame, window: int) -> DataFrame:
    """picked: (text, parts array<struct<fp, high, low, start, n>>) -> rows (fp, high, low, offset, word_high, word_low)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sizes, offsets, found = [], [], [], []
            for text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                joined, starts, ends = layout(word_list(text))
                for p in parts:
                    a, n = p["start"], p["n"]
                    keys.append((p["fp"], p["high"], p["low"]))
                    sizes.append(n)
                    offsets += range(n)
                    found += [joined[starts[i] : ends[i + window - 1]] for i in range(a, a + n)]
            columns = np.repeat(np.array(keys, dtype=np.int64).reshape(-1, 3), sizes, axis=0)
            high, low = words_hashes(found)
            names = ["fp", "high", "low", "offset", "word_high", "word_low"]
            return pa.RecordBatch.from_arrays([*(pa.array(columns[:, c]) for c in range(3)), pa.array(offsets, pa.int64()), pa.array(high), pa.array(low)], names)

        return step

    return map_arrow(picked, make, "fp long, high long, low long, offset long, word_high long, word_low long", rows=64)


def strip(rows: DataFrame, window: int, schema: str, extra: int) -> DataFrame:
    """rows: (id, text, spans array<struct<start, n, offsets>>, x0, ...) -> (id, n_words, n_removed, kept, x0, ...)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = word_list(text)
                n = len(words)
                if spans:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    for s in spans:
                        if s["offsets"] is None:
                            edge[s["start"]] += 1
                            edge[s["start"] + s["n"] + window - 1] -= 1
                        else:
                            at = s["start"] + np.array(s["offsets"], dtype=np.int64)
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + window, -1)
                    stays = np.cumsum(edge)[:n] == 0
                    words = [w for w, k in zip(words, stays.tolist(), strict=True) if k]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *(batch.column(3 + k) for k in range(extra))], ["id", "n_words", "n_removed", "kept", *(f"x{k}" for k in range(extra))])

        return step

    return map_arrow(rows, make, schema)


SPANS = "array<struct<start:bigint,n:bigint,offsets:array<bigint>>>"


def stripped(docs: DataFrame, spans: DataFrame, window: int, kinds: tuple[str, ...]) -> DataFrame:
    """docs: (id, mark, text, x0, ...) -> (id, n_words, n_removed, kept, x0, ...); documents without spans are not shuffled."""
    extra = [f"x{k}" for k in range(len(kinds))]
    flagged = maybe_in(docs, "mark", spans.select("mark"))
    clean = flagged.filter("NOT hit").select("id", "text", F.lit(None).cast(SPANS).alias("spans"), *extra)
    touched = flagged.filter("hit").alias("d").join(spans.alias("s"), F.expr("d.id <=> s.id AND d.mark = s.mark"), "left").select("d.id", "d.text", "s.spans", *[f"d.{x}" for x in extra])
    carried = "".join(f", {x} {kind}" for x, kind in zip(extra, kinds, strict=True))
    kind = docs.schema["id"].dataType.simpleString()
    return strip(clean.union(touched), window, f"id {kind}, n_words long, n_removed long, kept string{carried}", len(kinds))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, n_words, n_removed, kept, *carry), one per row of df.

    Each word covered by a window whose words also start elsewhere in df is removed; kept joins the others by one space.
    The table is loaded into an index of its own in batches, and resolved once; the index is dropped.
    """
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col, list(carry))
    index = FingerprintIndex(spark, scratch_path(spark, "substring-index"), docs.schema["id"].dataType.simpleString(), window, gram, keep_texts=False)
    for b in range(batches):
        index.add(docs.filter(F.pmod(F.xxhash64("id", "mark"), F.lit(batches)) == b))
        index.compact()
        index.drop_gone()  # this index has no manifest and ends with the call
    spans = index.resolve(index.repeated(), lambda marks: maybe_in(docs.select("id", "mark", "text"), "mark", marks).filter("hit"))
    for run in index.runs:
        index.drop(run)
    delete(spark, index.root)
    out = stripped(docs, spans, window, tuple(df.schema[c].dataType.simpleString() for c in carry))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", *[F.col(f"x{k}").alias(c) for k, c in enumerate(carry)])
