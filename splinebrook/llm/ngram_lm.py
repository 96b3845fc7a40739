"""A word-pair language model by deleted interpolation.

Classes are the model's vocabulary, one class of all rarer words, the end of a text, and a context for its start. The probability of a
class after another is a mixture of three maximum-likelihood estimates: uniform, single and pair. A rarer word's share of its class
follows its count plus one, with one place for all words never seen. The mixture's weights depend on how often the context was
seen (buckets of powers of two). One training document in SHARE is deleted from the counts, and expectation-maximisation
over the deleted documents' pairs, with estimates from the others, finds the weights; the final estimates use all training
documents.

The corpus is read three times, in chunks of bounded size:
1. words are counted by their spelling. The most frequent ones, at most VOCABULARY, are the vocabulary; their number is found
   from counts by size, and they are broadcast. As many again that are frequent in the other documents have their counts
   sent along, so that no word that is not broadcast is frequent.
2. pairs are counted. Those of the deleted documents feed expectation-maximisation, each round one aggregation to a row for each
   bucket. The most frequent, at most PAIRS, are broadcast with their probabilities.
3. each document adds up what is known of its tokens at once. Every other pair or word leaves with its document; all of one
   pair meet in one bucket, so that its count is known there, and they can't be many, as frequent pairs stayed behind.
   Documents' shares are added up within a bucket, and go back by the partition that their documents came from.

Pairs travel in buckets, a chunk's part of a bucket being one row with sorted numbers. There are as many buckets as shuffle
partitions, and more where a bucket would hold more than BUCKET_TOKENS tokens, so a task's memory is bounded.

Null texts are empty; an empty text is one end. Repeated rows count, and are scored, each for itself. An empty table gives no rows, and no
training rows a uniform model. Rows without an id are not learned from. Other columns are ignored. Texts are read whole. A row is
known by its place in the partitions of the input, which a table read from files keeps when a task runs again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint
from .ngrams import CHUNK_BYTES, END, numbered, strings, word_hashes

VOCABULARY, PAIRS = 1 << 17, 1 << 19
#: Pairs of fewer occurrences are never broadcast, nor kept after they are counted unless deleted documents have them.
LEAST_PAIR = 64
#: One in so many training documents is deleted from the counts that the weights are learned with.
SHARE = 6
#: Sizes of counts are told apart by eighths of a power of two where the broadcast words and pairs are chosen.
STEPS = 8
ROUNDS, TOLERANCE = 30, 1e-5
BUCKET_TOKENS = 1 << 22
BUCKETS = 64
KEPT, DELETED, OTHER = range(3)

TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


@dataclass
class Words:
    """The broadcast words: spelling, counts in training and in what is kept of it, and whether each has its own class."""

    spelling: pa.Array
    count: np.ndarray
    kept: np.ndarray
    own: np.ndarray
    total: int
    different: int
    kept_total: int
    documents: int
    kept_documents: int
    _places: dict[bytes, int] | None = field(default=None, repr=False)

    def __post_init__(self):
        n = len(self.spelling)
        self.rare, self.start = n, n + 1
        self.size = n + 2
        #: Classes are places among the words; the rarer ones share one.
        self.classes = np.where(self.own, np.arange(n), self.rare)
        self.kinds = int(self.own.sum()) + 1
        rare = self.total - int(self.count[self.own].sum())
        #: Rarer words' occurrences and spellings, with one for all that were never seen.
        self.rare_places = rare + self.different - int(self.own.sum()) + 1
        #: Counts of classes, as tokens and as contexts.
        self.tokens = np.concatenate([self.count, [rare, self.documents]])
        self.kept_tokens = np.concatenate([self.kept, [self.kept_total - int(self.kept[self.own].sum()), self.kept_documents]])

    def __getstate__(self):
        return self.__dict__ | {"_places": None}

    def places(self, tokens: pa.Array) -> np.ndarray:
        """The place of each token among the words, or -1."""
        if self._places is None:
            self._places = {w: k for k, w in enumerate(self.spelling.cast(pa.binary()).to_pylist())}
        get = self._places.get
        return np.fromiter((get(t, -1) for t in tokens.to_pylist()), dtype=np.int64, count=len(tokens))

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of add-one probabilities."""
        return np.log10((count + 1) / (self.total + self.different + 1))

    def share(self, count: np.ndarray) -> np.ndarray:
        """log10 of rarer words' shares of their class."""
        return np.log10((count + 1) / self.rare_places)

    def estimates(self, context: np.ndarray, token: np.ndarray, pair: np.ndarray, kept: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of the context's count, single estimate, pair estimate)."""
        counts, total = (self.kept_tokens, self.kept_total) if kept else (self.tokens, self.total)
        seen = counts[context]
        return bucket(seen), counts[token] / max(total, 1), pair / np.maximum(seen, 1)

    def probability(self, weights: np.ndarray, context: np.ndarray, token: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 of the mixture's probability of each class after its context."""
        at, single, double = self.estimates(context, token, pair)
        w = weights[at]
        return np.log10(w[:, 0] / self.kinds + w[:, 1] * single + w[:, 2] * double)


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than its count's whole power of two."""
    return np.frexp(np.asarray(count, dtype=np.float64))[1]


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, bytes]]:
    """(rest of the columns by document, kinds, bytes of tokens with an end after each document) from (text, kind, ...) rows."""
    texts, kinds, rest, size = [], [], [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[1:]]
        for k in range(batch.num_rows):
            text = batch.column(0)[k]
            found = text.as_buffer().to_pybytes() if text.is_valid and len(text.as_buffer()) else b""
            texts.append(found.translate(TABLE))
            kinds.append(columns[0][k])
            rest.append(tuple(c[k] for c in columns[1:]))
            size += len(found) + 64
            if size >= CHUNK_BYTES:
                yield rest, np.array(kinds), b"".join(t + b" " + END + b" " for t in texts)
                texts, kinds, rest, size = [], [], [], 0
    if texts:
        yield rest, np.array(kinds), b"".join(t + b" " + END + b" " for t in texts)


def token_documents(tokens: pa.Array, codes: np.ndarray) -> np.ndarray:
    """The document of each token."""
    end = tokens.index(pa.scalar(END, pa.large_binary())).as_py()
    ends = codes == end
    return np.cumsum(ends) - ends


def by_kind(codes: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(codes * 3 + kinds, minlength=3 * n).reshape(n, 3)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, kinds, data in documents(batches):
        tokens, codes = numbered(data)
        counts = by_kind(codes.astype(np.int64), kinds[token_documents(tokens, codes)], len(tokens))
        found = counts.any(axis=1)
        yield pa.RecordBatch.from_arrays([strings(tokens.filter(pa.array(found))), *(pa.array(counts[found, k]) for k in range(3))], ["word", "kept", "deleted", "other"])


def classified(words: Words, data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, code and place of each, its document, key of the pair of classes that it ends)."""
    tokens, codes = numbered(data)
    doc = token_documents(tokens, codes)
    places = words.places(tokens)
    classes = np.append(words.classes, words.rare)[places]  # -1 is the last: rare
    token = classes[codes]
    context = np.empty_like(token)
    context[1:] = token[:-1]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    context[first] = words.start
    return tokens, codes, places[codes], doc, context * words.size + token


def packed(sorted_numbers: np.ndarray) -> bytes:
    """Differences of sorted numbers, in four bytes each if they fit, else in eight."""
    steps = np.diff(sorted_numbers, prepend=0)
    return steps.astype(np.int32 if len(steps) == 0 or steps.max() < 1 << 31 else np.int64).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=np.int32 if len(data) == 4 * n else np.int64), dtype=np.int64)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order of keys by bucket (key mod buckets) and key, and each bucket's part of it."""
    place = keys % buckets * (int(keys.max(initial=0)) // buckets + 1) + keys // buckets
    order = np.argsort(place)
    borders = np.searchsorted(keys[order] % buckets, np.arange(buckets + 1))
    return order, [(b, slice(int(borders[b]), int(borders[b + 1]))) for b in np.flatnonzero(np.diff(borders)).tolist()]


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """(key, its rows) of rows that are sorted by the key."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != at and held:
                yield at, held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield at, held


def pair_counter(held: Broadcast, buckets: int):
    """A chunk's counts of pairs, a row for each bucket."""

    def count(batches):
        for _, kinds, data in documents(batches):
            _, _, _, doc, key = classified(held.value, data)
            found, inverse = np.unique(key, return_inverse=True)
            counts = by_kind(inverse, kinds[doc], len(found)).astype(np.int32)
            order, parts = dealt(found, buckets)
            columns = [[b for b, _ in parts], [packed(found[order[p]] // buckets) for _, p in parts], [counts[order[p]].tobytes() for _, p in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "counts"])

    return count


def pair_summer(buckets: int, least: int):
    """Counts of the pairs that deleted documents have or that are frequent."""

    def total(batches):
        for bucket, rows in grouped(batches, "bucket"):
            counts = [np.frombuffer(r["counts"], dtype=np.int32).reshape(-1, 3) for r in rows]
            keys = np.concatenate([unpacked(r["keys"], len(c)) for r, c in zip(rows, counts, strict=True)])
            found, inverse = np.unique(keys, return_inverse=True)
            sums = np.stack([np.bincount(inverse, weights=np.concatenate([c[:, k] for c in counts]), minlength=len(found)) for k in range(3)], axis=1).astype(np.int64)
            wanted = (sums[:, DELETED] > 0) | (sums.sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([pa.array(found[wanted] * buckets + bucket), *(pa.array(sums[wanted, k]) for k in range(3))], ["pair", "kept", "deleted", "other"])

    return total


def together(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    return rows.repartition(tasks, key).sortWithinPartitions(key)


def size_of(count: Column) -> Column:
    return F.floor(F.log2(count) * STEPS).cast("int")


def least_size(df: DataFrame, count: Column, most: int) -> int:
    """The least size of counts such that at most `most` rows have it or more."""
    found = df.filter(count > 0).groupBy(size_of(count).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, BUCKETS * STEPS
    for size, n in sorted(((r[0], r[1]) for r in found), reverse=True):
        total += n
        if total > most:
            break
        least = size
    return least


@dataclass
class Model:
    words: Broadcast  # of Words
    weights: np.ndarray  # a row for each bucket: uniform, single, pair
    pairs: Broadcast  # (sorted pairs, log10 probabilities) of the frequent ones
    buckets: int


def marked(docs: DataFrame, train: Column, id_col: str, text_col: str, *more: Column) -> DataFrame:
    kind = F.when(~F.coalesce(train, F.lit(False)), OTHER).when(F.pmod(F.xxhash64(id_col), F.lit(SHARE)) == 0, DELETED).otherwise(KEPT)
    return docs.select(F.col(text_col).alias("text"), kind.alias("kind"), *more)


def train_model(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, pairs: int = PAIRS, least_pair: int = LEAST_PAIR) -> Model:
    spark = docs.sparkSession
    rows = marked(docs, train, id_col, text_col)
    sums = [F.sum(c).alias(c) for c in ("kept", "deleted", "other")]
    counted = checkpoint(rows.mapInArrow(count_words, "word string, kept long, deleted long, other long").groupBy("word").agg(*sums))
    seen, every = F.col("kept") + F.col("deleted"), F.col("kept") + F.col("deleted") + F.col("other")
    total, different, kept = (x or 0 for x in counted.agg(F.sum(seen), F.sum((seen > 0).cast("long")), F.sum("kept")).first())
    own = F.when(seen > 0, size_of(seen) >= least_size(counted, seen, vocabulary)).otherwise(False)
    end = F.col("word") == END.decode()
    sent = counted.filter(own | end | (size_of(every) >= least_size(counted, every, vocabulary))).select("word", seen.alias("n"), "kept", (own | (end & (seen > 0))).alias("own")).toArrow()
    spelling = sent["word"].combine_chunks().cast(pa.string())
    count, few = sent["n"].to_numpy().astype(np.int64), sent["kept"].to_numpy().astype(np.int64)
    at = spelling.index(pa.scalar(END.decode())).as_py()
    ends = (int(count[at]), int(few[at])) if at >= 0 else (0, 0)
    words = Words(spelling, count, few, sent["own"].to_numpy(zero_copy_only=False).astype(bool), total, different, kept, *ends)
    held = spark.sparkContext.broadcast(words)

    tokens = counted.agg(F.sum(every)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // BUCKET_TOKENS + 1)
    parts = together(rows.mapInArrow(pair_counter(held, buckets), "bucket int, keys binary, counts binary"), "bucket", buckets)
    keys = checkpoint(parts.mapInArrow(pair_summer(buckets, least_pair), "pair long, kept long, deleted long, other long"))
    weights = learn(keys.filter("deleted > 0"), held)
    often = keys.filter((every >= least_pair) & (size_of(every) >= least_size(keys.filter(every >= least_pair), every, pairs))).select("pair", seen.alias("n")).toArrow()
    order = np.argsort(often["pair"].to_numpy())
    frequent, n = often["pair"].to_numpy()[order], often["n"].to_numpy()[order]
    known = words.probability(weights, frequent // words.size, frequent % words.size, n)
    return Model(held, weights, spark.sparkContext.broadcast((frequent, known)), buckets)


def learn(pairs: DataFrame, held: Broadcast) -> np.ndarray:
    """Weights for each bucket of context counts, from the deleted documents' pairs and estimates from the kept ones."""

    def prepare(batches):
        for batch in batches:
            words = held.value
            key = batch.column(0).to_numpy()
            at, single, double = words.estimates(key // words.size, key % words.size, batch.column(1).to_numpy(), kept=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(single), pa.array(double), batch.column(2)], ["bucket", "single", "double", "n"])

    rows = pairs.select("pair", "kept", "deleted").mapInArrow(prepare, "bucket int, single double, double double, n long")
    rows = checkpoint(rows.groupBy("bucket", "single", "double").agg(F.sum("n").alias("n")))
    weights, before, uniform = np.full((BUCKETS, 3), 1 / 3), -math.inf, 1 / held.value.kinds
    if not held.value.total:
        return np.tile([1.0, 0.0, 0.0], (BUCKETS, 1))
    for _ in range(ROUNDS):
        parts = [F.element_at(F.array(*[F.lit(float(w)) for w in weights[:, k]]), F.col("bucket") + 1) * p for k, p in enumerate((F.lit(uniform), F.col("single"), F.col("double")))]
        split = rows.select("bucket", "n", *[p.alias(f"p{k}") for k, p in enumerate(parts)]).withColumn("p", F.col("p0") + F.col("p1") + F.col("p2"))
        sums = split.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(f"p{k}") / F.col("p")) for k in range(3)], F.sum(F.col("n") * F.log("p"))).collect()
        total = np.array([r[1:4] for r in sums]).sum(axis=0) if sums else np.ones(3)
        prior = (total + 1) / (total + 1).sum()  # a bucket starts from all buckets' weights, counted once
        weights = np.tile(prior, (BUCKETS, 1))
        for r in sums:
            weights[r[0]] = (np.array(r[1:4]) + prior) / (sum(r[1:4]) + 1)
        after = sum(r[4] for r in sums)
        if abs(after - before) <= TOLERANCE * abs(after):
            break
        before = after
    return weights


#: Bits of a row's number within its partition, in monotonically_increasing_id.
ROW_BITS = 33
OWN = [("row", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]


def shares(id_kind: pa.DataType, model: Model):
    """A chunk's documents with what is known of them at once, and their other pairs and words, a row for each bucket.

    docs: for each pair or word twice the document's place in the chunk, plus one for a training row; rows of a chunk follow each
    other.
    """
    held, pairs, buckets = model.words, model.pairs, model.buckets
    own = pa.struct([*OWN, ("id", id_kind)])
    kinds_of = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(own))

    def run(batches):
        words, (frequent, scores) = held.value, pairs.value
        for rest, kinds, data in documents(batches):
            tokens, codes, place, doc, key = classified(words, data)
            n = len(rest)
            counts = np.append(words.count, 0)[place]
            found, rare = place >= 0, np.append(words.classes, words.rare)[place] == words.rare
            base = np.where(found, words.base(counts), 0.0)
            score = np.where(found & rare, words.share(counts), 0.0)
            at = np.minimum(np.searchsorted(frequent, key), max(len(frequent) - 1, 0))
            often = frequent[at] == key if len(frequent) else np.zeros(len(key), dtype=bool)
            score[often] += scores[at[often]]
            ids = np.array([r[0] for r in rest], dtype=np.int64)
            first = int(ids[0])
            assert int(ids[-1]) - first == n - 1
            sums = [ids, np.bincount(doc, minlength=n), np.bincount(doc, weights=found & (counts > 0), minlength=n).astype(np.int64), *(np.bincount(doc, weights=x, minlength=n) for x in (base, score))]
            whole = pa.StructArray.from_arrays([*(pa.array(s, k) for s, (_, k) in zip(sums, OWN, strict=True)), pa.array([r[1] for r in rest], id_kind)], fields=list(own))
            out = [(first % buckets, first, None, None, None, whole.to_pylist())]
            marks = (np.arange(n) * 2 + (kinds != OTHER)).astype(np.int32)
            left = np.flatnonzero(~often)
            order, parts = dealt(key[left], buckets)
            left = left[order]
            out += [(b, first, packed(key[left[p]] // buckets), None, marks[doc[left[p]]].tobytes(), None) for b, p in parts]
            new = np.flatnonzero(~found)
            if len(new):
                spelled, hashes = strings(tokens), word_hashes(tokens, 0)
                order, parts = dealt((hashes[codes[new]] % np.uint64(buckets)).astype(np.int64), buckets)
                new = new[order]
                out += [(b, first, None, spelled.take(pa.array(codes[new[p]])).to_pylist(), marks[doc[new[p]]].tobytes(), None) for b, p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_of, strict=True)], ["bucket", "first", "keys", "words", "docs", "own"])

    return run


def totals(id_kind: pa.DataType, model: Model):
    """For each bucket the shares of its pairs and words in each document, a row for each partition that documents came from. The
    documents' own sums go with them."""
    held, weights, buckets = model.words, model.weights, model.buckets
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.struct([*OWN, ("id", id_kind)])))

    def marks(row):
        found = np.frombuffer(row["docs"], dtype=np.int32).astype(np.int64)
        return row["first"] + found // 2, found % 2

    def run(batches):
        words = held.value
        for bucket, rows in grouped(batches, "bucket"):
            out = [(r["first"] >> ROW_BITS, None, None, None, None, r["own"]) for r in rows if r["own"]]
            pairs, spelled = [r for r in rows if r["keys"] is not None], [r for r in rows if r["words"] is not None]
            row, known, base, score = [], [], [], []
            if pairs:
                key = np.concatenate([unpacked(r["keys"], len(r["docs"]) // 4) for r in pairs]) * buckets + bucket
                at, learned = (np.concatenate(x) for x in zip(*map(marks, pairs), strict=True))
                keys, inverse = np.unique(key, return_inverse=True)
                count = np.bincount(inverse, weights=learned, minlength=len(keys))
                row.append(at)
                score.append(words.probability(weights, keys // words.size, keys % words.size, count)[inverse])
                base.append(np.zeros(len(at)))
                known.append(np.zeros(len(at)))
            if spelled:
                at, learned = (np.concatenate(x) for x in zip(*map(marks, spelled), strict=True))
                coded = pa.chunked_array([pa.array(r["words"], pa.string()) for r in spelled]).combine_chunks().dictionary_encode()
                inverse = coded.indices.to_numpy()
                count = np.bincount(inverse, weights=learned, minlength=len(coded.dictionary))
                row.append(at)
                known.append((count > 0)[inverse])
                base.append(words.base(count)[inverse])
                score.append(words.share(count)[inverse])
            if row:
                found, inverse = np.unique(np.concatenate(row), return_inverse=True)
                sums = [np.bincount(inverse, weights=np.concatenate(x), minlength=len(found)) for x in (known, base, score)]
                sums[0] = sums[0].astype(np.int64)
                borders = np.flatnonzero(np.diff(found >> ROW_BITS, prepend=-1, append=-1))
                out += [(int(found[a]) >> ROW_BITS, found[a:b], *(x[a:b] for x in sums), None) for a, b in zip(borders[:-1], borders[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "rows", "known", "base", "score", "own"])

    return run


def summed_up(id_kind: pa.DataType):
    """The documents of each partition with all their shares."""

    def run(batches):
        for _, found in grouped(batches, "part"):
            own = [x for r in found if r["own"] for x in r["own"]]
            order = sorted(range(len(own)), key=lambda k: own[k]["row"])
            rows = np.array([own[k]["row"] for k in order], dtype=np.int64)
            shares = [r for r in found if r["rows"] is not None]
            at = np.searchsorted(rows, np.concatenate([np.array(r["rows"], dtype=np.int64) for r in shares])) if shares else np.zeros(0, dtype=np.int64)
            columns = []
            for name, kind in OWN[2:]:
                more = np.concatenate([np.array(r[name], dtype=float) for r in shares]) if shares else np.zeros(0)
                total = np.array([own[k][name] for k in order], dtype=float) + np.bincount(at, weights=more, minlength=len(rows))
                columns.append(pa.array(total.astype(np.int64) if kind == pa.int64() else total))
            yield pa.RecordBatch.from_arrays([pa.array([own[k]["id"] for k in order], id_kind), pa.array([own[k]["n"] for k in order], pa.int64()), *columns], ["id", "n", "known", "base", "score"])

    return run


def score(docs: DataFrame, model: Model, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score), one for each of docs, the table that the model was trained on.

    train: the training rows, as in train_model: the third reading counts the rarer pairs and words again.
    """
    id_field = docs.schema[id_col]
    kind, sql_kind = to_arrow_type(id_field.dataType), id_field.dataType.simpleString()
    rows = marked(docs, train, id_col, text_col, F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))
    own = f"array<struct<row: bigint, n: bigint, known: bigint, base: double, score: double, id: {sql_kind}>>"
    parts = rows.mapInArrow(shares(kind, model), f"bucket int, first long, keys binary, words array<string>, docs binary, own {own}")
    found = together(parts, "bucket", model.buckets).mapInArrow(totals(kind, model), f"part long, rows array<long>, known array<long>, base array<double>, score array<double>, own {own}")
    sums = together(found, "part", model.buckets).mapInArrow(summed_up(kind), f"id {sql_kind}, n long, known long, base double, score double")
    train_tokens = F.lit(model.words.value.total).cast("long").alias("train_tokens")
    return sums.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), train_tokens, F.col("base").alias("base_score"), "score")
