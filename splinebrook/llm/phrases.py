"""Collocations by best-first branch-and-bound growth of phrases.

Phrases grow word by word from their beginnings. With a = f(phrase) and a cut into a first part with count l and a rest with
count r, the score is floor(2000000 a / (l + r)), a phrase's own score that of its lowest cut. Whatever a phrase p of count
f grows into has at most f occurrences, its first word keeps its count l, and its rest is at least as frequent as the
whole; so no phrase that begins with p scores above floor(2000000 f / (l + f)). This bound decides whether p is grown:

1. All words are counted, then all pairs of words that are frequent enough. Every pair is a candidate with a known score.
2. The corpus is cut down to runs of frequent pairs, equal runs of a chunk counted once; rounds read this table only.
3. In each round the threshold of a language is its `top`-th best score among candidates not known to be dropped. Phrases
   whose bound reaches the threshold, and candidates that reach it but whose longer phrases are not counted yet, are opened:
   all phrases with one word more at either end are counted. A candidate is settled by them: if a longer phrase drops
   it, one that is longer by one word does too. A four-word phrase whose inner counts are missing has an upper bound for a
   score and asks for them.
4. When nothing at or above the threshold waits, the `top` best survivors and all ties are settled. A round opens ahead of
   the threshold, twice as far in each round, so that there are about log(candidates / top) of them.

Everything is exact: filters only let too many phrases through, and counts are sums over the whole corpus. Scores are integers of
at most a million, so thresholds come from counts by score and no language's candidates are ever gathered.

Null texts are empty, null languages `und`. Repeated rows count as often as they occur. Empty tables and languages without
words give no rows. Extra columns are ignored. Ties go to the more frequent phrase, then to the lesser in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, scratch_path, sliced
from .ngrams import CHUNK_BYTES, END, chained, is_word, joined, members, numbered, strings, summed, windows, word_hashes

LEAST = 30
TOP = 2000
LONGEST = 4
#: A candidate goes if a longer phrase has this share of its occurrences, in hundredths.
SHARE = 80
SCALE = 2_000_000
#: Rounds beyond which something must be wrong; opening doubles in each.
MAX_ROUNDS = 60
BATCH_ROWS = 1 << 15

#: Lower-cases A-Z, turns tabs into spaces and all that ends a piece into one byte.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + END * 9)
COUNTS = "lang string, phrase string, n long"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, tokens of its texts with an end after each piece) in chunks of bounded size, from columns lang and text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid and len(found := text.as_buffer()):
                held.setdefault(lang, []).append(found.to_pybytes())
                size += len(found)
            if size >= CHUNK_BYTES:
                yield from spaced(held)
                held, size = {}, 0
    yield from spaced(held)


def spaced(held: dict[str, list[bytes]]) -> Iterator[tuple[str, bytes]]:
    for lang, texts in held.items():
        for part in windows(END.join(texts).translate(TABLE)):
            yield lang, (part + END).replace(END, b" " + END + b" ")


def rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded size."""
    batch = pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(counts), dtype=np.int32))), phrases, pa.array(counts, pa.int64())], ["lang", "phrase", "n"])
    yield from sliced(iter([batch]), BATCH_ROWS)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words; a null word has the number of all."""
    for lang, data in pieces(batches):
        tokens, codes = numbered(data)
        counts = np.bincount(codes, minlength=len(tokens))
        word = is_word(tokens) & (counts > 0)
        if word.any():
            yield from rows(lang, strings(tokens.filter(pa.array(word))), counts[word])
            yield from rows(lang, pa.nulls(1, pa.string()), counts[word].sum(keepdims=True))


def seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def pair_counter(frequent: Broadcast):
    def count(batches):
        for lang, data in pieces(batches):
            tokens, codes = numbered(data)
            likely = is_word(tokens) & frequent.value.has(word_hashes(tokens, seed(lang)))
            here = np.flatnonzero(likely[codes[:-1]] & likely[codes[1:]])
            if len(here):
                first, n = summed([codes[here], codes[here + 1]], np.ones(len(here)), len(tokens))
                words = strings(tokens)
                yield from rows(lang, joined([words.take(pa.array(codes[here[first] + k])) for k in (0, 1)]), n)

    return count


def run_finder(frequent: Broadcast):
    """Rows (lang, run, n): the longest runs of at least three words whose neighbours make frequent pairs."""

    def find(batches):
        for lang, data in pieces(batches):
            tokens, codes = numbered(data)
            hashes, word = word_hashes(tokens, seed(lang)), is_word(tokens)
            linked = np.zeros(len(codes) + 1, dtype=bool)  # whether a token goes with the one before
            if len(codes) > 1:
                linked[1:-1] = word[codes[:-1]] & word[codes[1:]] & frequent.value.has(chained(hashes[codes[:-1]], hashes[codes[1:]]))
            starts = np.flatnonzero(~linked[:-1] & linked[1:])
            ends = np.flatnonzero(linked[:-1] & ~linked[1:]) + 1
            long = ends - starts >= 3
            starts, ends = starts[long], ends[long]
            if len(starts):
                lengths = ends - starts
                borders = np.concatenate([[0], np.cumsum(lengths)])
                inside = np.arange(borders[-1]) + np.repeat(starts - borders[:-1], lengths)
                lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), strings(tokens).take(pa.array(codes[inside])))
                found = pc.value_counts(pc.binary_join(lists, " "))
                yield from rows(lang, found.field("values"), found.field("counts").to_numpy())

    return find


def grower(pairs: Broadcast, triples: Broadcast):
    """Counts of phrases of three words that begin or end with one of the pairs, and of four with one of the triples."""

    def count(batches):
        for lang, data, weights in gathered(batches):
            tokens, codes = numbered(data)
            hashes, word = word_hashes(tokens, seed(lang)), is_word(tokens)[codes]
            weight = weights[np.cumsum(~word)]
            words = strings(tokens)
            own = hashes[codes]
            base, whole = own, word
            for size, opened in ((2, pairs.value), (3, triples.value)):
                base = chained(base[:-1], own[size - 1 :])  # of the `size` words from each place
                whole = whole[:-1] & word[size - 1 :]
                wanted = whole & opened.has(base)
                here = np.flatnonzero((wanted[:-1] | wanted[1:]) & whole[:-1] & whole[1:])
                if len(here):
                    first, n = summed([codes[here + k] for k in range(size + 1)], weight[here], len(tokens))
                    yield from rows(lang, joined([words.take(pa.array(codes[here[first] + k])) for k in range(size + 1)]), n)

    return count


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, np.ndarray]]:
    """(language, runs with an end between them, how often each occurs) in chunks of bounded size."""
    held: dict[str, list[pa.RecordBatch]] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            runs, n = (pa.chunked_array([p.column(k) for p in parts]).combine_chunks() for k in (1, 2))
            one = pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), runs)
            yield lang, pc.binary_join(one, f" {END.decode()} ")[0].as_buffer().to_pybytes(), n.to_numpy()

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = batch if len(langs.dictionary) == 1 else batch.filter(pc.equal(langs.indices, k))
            held.setdefault(lang, []).append(own)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield from out()
            held, size = {}, 0
    yield from out()


def totals(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("phrase").isNull() | (F.col("a") >= least))


def exact(c: str) -> F.Column:
    return F.col(c).cast("decimal(19,0)")


def scored(phrases: DataFrame, facts: DataFrame) -> DataFrame:
    """phrases (lang, phrase, size, a) with l, r and score of the lowest cut, `first` (the count of the first word) and `sure`.

    A part that is not among the facts counts a, the least it can be, and makes the score an upper bound: sure is false.
    """
    words = F.split("phrase", " ")
    parts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("head"), F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("rest")))
    cuts = phrases.select("lang", "phrase", "size", "a", F.explode(parts).alias("c")).select("lang", "phrase", "size", "a", "c.k", "c.head", "c.rest")
    heads = facts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l0"))
    rests = facts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r0"))
    known = cuts.join(heads, ["lang", "head"], "left").join(rests, ["lang", "rest"], "left")
    known = known.withColumn("l", F.coalesce("l0", "a")).withColumn("r", F.coalesce("r0", "a"))
    score = F.expr(f"cast(cast(a AS decimal(19,0)) * {SCALE} AS decimal(30,0)) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    known = known.withColumn("score", score)
    best = known.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.bool_and(F.col("l0").isNotNull() & F.col("r0").isNotNull()).alias("sure"), F.max(F.when(F.col("k") == 1, F.col("l"))).alias("first"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score", "first", "sure")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first `top` surviving phrases of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = checkpoint(totals(texts.mapInArrow(count_words, COUNTS), least))
    words = counted.filter("phrase IS NOT NULL")
    pairs = totals(texts.mapInArrow(pair_counter(members(words.select("lang", "phrase"))), COUNTS), least)
    pairs = checkpoint(scored(pairs.withColumn("size", F.lit(2)), words))
    at = scratch_path(spark, "runs")
    texts.mapInArrow(run_finder(members(pairs.select("lang", "phrase"))), COUNTS).write.parquet(at)
    runs = spark.read.parquet(at)

    nothing = pairs.filter("false")
    triples, fours, opened = nothing, nothing.select("lang", "phrase", "size", "a"), nothing.select("lang", "phrase")
    for ahead in range(1, MAX_ROUNDS):
        facts = words.select("lang", "phrase", "a").unionByName(pairs.select("lang", "phrase", "a")).unionByName(triples.select("lang", "phrase", "a"))
        longer = triples.select("lang", "phrase", "size", "a").unionByName(fours)
        inner = F.array(F.array_join(F.slice(F.split("phrase", " "), 1, F.col("size") - 1), " "), F.array_join(F.slice(F.split("phrase", " "), 2, F.col("size") - 1), " "))
        within = longer.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
        state = pairs.unionByName(triples).unionByName(scored(fours, facts))
        state = state.join(within, ["lang", "phrase"], "left").join(opened.withColumn("open", F.lit(True)), ["lang", "phrase"], "left")
        dropped = F.coalesce(100 * exact("longest") >= SHARE * exact("a"), F.lit(False))
        bound = F.expr(f"cast(cast(a AS decimal(19,0)) * {SCALE} AS decimal(30,0)) div (cast(first AS decimal(19,0)) + cast(a AS decimal(19,0)))")
        state = checkpoint(state.select("lang", "phrase", "size", "a", "l", "r", "score", "sure", dropped.alias("dropped"), F.coalesce("open", F.lit(False)).alias("open"), bound.alias("bound")))

        by_score = state.filter("NOT dropped").groupBy("lang", "score").agg(F.count(F.lit(1)).alias("k"))
        so_far = by_score.withColumn("k", F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("score"))))
        reach = top << ahead
        lines = so_far.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("k") >= top, F.col("score"))), F.lit(0)).alias("line"), F.coalesce(F.max(F.when(F.col("k") >= reach, F.col("score"))), F.lit(0)).alias("far"))
        placed = state.join(lines, "lang")
        wait = (F.col("size") < LONGEST) & ~F.col("open")
        best = F.when(F.col("dropped"), F.col("bound")).otherwise(F.greatest("bound", "score"))
        asks = placed.filter(wait).select("lang", "phrase", best.alias("best"), "line", "far")
        unsure = placed.filter("NOT sure").select("lang", F.array_join(F.slice(F.split("phrase", " "), 2, 2), " ").alias("phrase"), F.col("score").alias("best"), "line", "far")
        asks = asks.unionByName(unsure)
        if asks.filter("best >= line").isEmpty():
            break
        new = checkpoint(asks.filter("best >= far").select("lang", "phrase").distinct().join(opened, ["lang", "phrase"], "left_anti"))
        opened = checkpoint(opened.unionByName(new))
        size = F.size(F.split("phrase", " "))
        grown = runs.mapInArrow(grower(members(new.filter(size == 2)), members(new.filter(size == 3))), COUNTS)
        found = checkpoint(totals(grown, least).select("lang", "phrase", size.alias("size"), "a"))
        fresh = found.filter("size = 3").join(triples.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
        triples = checkpoint(triples.unionByName(scored(fresh, facts)))
        fours = checkpoint(fours.unionByName(found.filter("size = 4")).distinct())
    else:
        raise RuntimeError("the frontier has not settled")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = placed.filter("NOT dropped AND score >= line").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    n = counted.filter("phrase IS NULL").select("lang", F.col("a").alias("n"))
    return kept.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
