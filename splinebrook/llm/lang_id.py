"""Language identification by a linear-chain conditional random field over words.

Each word is labelled with a language: its score for a label is the sum of weights of its character n-grams (those at
either end, with the border as a character, are its affixes) and of the word itself where the lexicon has it; learned
transitions tie neighbouring words together. Forward-backward gives each word's probabilities over the whole text, and a
document's language is the one with the largest share of them, which is also the score. Code-switched texts are thus split
among languages; `switches` gives their runs of words of one language.

A text of any number of words is one chain. It is worked on in segments: each gives the matrix of what passes from its
left to its right end, the matrices of a text give the messages that reach every segment from both sides, and with these
the segments are decoded together. The result is that of one pass over the whole chain, wherever the segments lie.

Labels of training documents hold for whole documents; training chains are spliced from pieces of documents of different
languages, so that the transitions are learned on switched text.

Texts that are null or have no letter get the language `und` and the score 0. Ties go to the language that sorts first.
Where no labelled document can be learned from, all texts get `und`. Repeated rows each get a row of their own, an empty
table gives none, and texts are read whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

UNKNOWN = "und"
#: Labelled documents that the model is fitted on, shared evenly among the languages, and how many of each are taken at
#: least (or all that there are) where there are so many languages that the share would be smaller.
TRAIN_ROWS = 800
LANG_ROWS = 8
#: Characters of the passage that is learned from in a longer training text; it starts where a hash of the id says.
TRAIN_CHARS = 20_000
#: How many times the rows that are wanted of a language are let through to the sort that draws them.
SPARE = 4
#: Words of a segment of a chain, and segments that are held in memory together.
SEGMENT = 128
SEGMENTS = 2048
ORDERS = (2, 3, 4)
HASH_BITS = 16
#: Words of the lexicon, at most; the most frequent of the training sample.
LEXICON = 5_000
ROUNDS = 40
RATE = 0.5
DECAY = 1e-3
SEED = 5
#: Words of a spliced piece.
PIECE = (4, 40)

WORD = re.compile(r"[^\W\d_]+")
LETTER = r"\p{L}"


def words_of(text: str | None) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


@dataclass
class Features:
    """Hashed n-grams of distinct words: flat n-gram indices, and where each word's begin."""

    grams: np.ndarray
    starts: np.ndarray
    lexical: np.ndarray

    @staticmethod
    def of(words: list[str], lexicon: dict[str, int]) -> Features:
        flat = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        border = flat == 0
        word = np.cumsum(border) - 1  # of each character; a border belongs to the word it opens
        grams, owners = [], []
        for order in ORDERS:
            n = len(flat) - order + 1
            if n <= 0:
                continue
            h = np.full(n, order, dtype=np.uint64)
            spans = np.zeros(n, dtype=bool)
            for k in range(order):
                h = (h * np.uint64(0x9E3779B1) + flat[k : n + k]) & np.uint64(0xFFFFFFFFFFFF)
                if 0 < k < order - 1:
                    spans |= border[k : n + k]
            h ^= h >> np.uint64(21)
            inside = np.flatnonzero(~spans)
            grams.append((h[inside] & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64))
            owners.append(word[inside])
        owner, gram = np.concatenate(owners), np.concatenate(grams)
        keep = owner < len(words)
        owner, gram = owner[keep], gram[keep]
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(words)))
        return Features(gram[order], starts, np.array([lexicon.get(w, -1) for w in words], dtype=np.int64))


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # hashed n-grams x labels
    lexical: np.ndarray  # lexicon x labels; the last row is for words outside it
    transitions: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, f: Features) -> np.ndarray:
        return np.add.reduceat(self.weights[f.grams], f.starts, axis=0) + self.lexical[f.lexical] if len(f.starts) else np.zeros((0, len(self.labels)))

    def exponentials(self, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.exp(emissions - emissions.max(axis=2, keepdims=True)), np.exp(self.transitions - self.transitions.max())

    def passage(self, emissions: np.ndarray, valid: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """(segments, labels, labels): from each label before a segment to each at its end, up to a factor; opens: none is before."""
        e, t = self.exponentials(emissions)
        out = np.where(opens[:, None, None], 1.0, t[None]) * e[:, 0, None, :]
        for s in range(1, e.shape[1]):
            step = (out @ t) * e[:, s, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            out = np.where(valid[:, s, None, None], step, out)
        return out

    def marginals(self, emissions: np.ndarray, valid: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over (chains, steps, labels): word marginals, and the expected transitions over all chains.

        before: what comes in at the left of each chain (all ones after the transition where nothing does); after: at its
        right.
        """
        e, t = self.exponentials(emissions)
        n, steps, k = e.shape
        forward = np.empty_like(e)
        a = e[:, 0] if before is None else e[:, 0] * before
        a = a / a.sum(axis=1, keepdims=True)
        forward[:, 0] = a
        for s in range(1, steps):
            a = (a @ t) * e[:, s]
            a /= a.sum(axis=1, keepdims=True)
            forward[:, s] = a
        b = np.ones((n, k)) if after is None else after
        marginals = np.empty_like(e)
        last = forward[:, -1] * b
        marginals[:, -1] = last / last.sum(axis=1, keepdims=True)
        pairs = np.zeros((k, k))
        for s in range(steps - 2, -1, -1):
            ahead = e[:, s + 1] * b
            live = valid[:, s + 1, None]
            back = ahead @ t.T
            total = (forward[:, s] * back).sum(axis=1, keepdims=True)
            pairs += ((forward[:, s] / total * live).T @ ahead) * t
            b = np.where(live, back / back.sum(axis=1, keepdims=True), b)
            m = forward[:, s] * b
            marginals[:, s] = m / m.sum(axis=1, keepdims=True)
        return marginals, pairs

    def chain_marginals(self, per_word: np.ndarray, index: np.ndarray, lengths: list[int], segment: int = SEGMENT, segments: int = SEGMENTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, marginals) of the words of whole chains that lie one after another; per_word: emissions by word number."""
        k = len(self.labels)
        chain, place, firsts, sizes = segmented(lengths, segment)
        _, t = self.exponentials(np.zeros((1, 1, k)))
        before, after = np.ones((len(firsts), k)), np.ones((len(firsts), k))
        cut = np.flatnonzero((np.bincount(chain, minlength=len(lengths)) > 1)[chain])
        matrix = np.empty((len(cut), k, k))
        for lo in range(0, len(cut), segments):
            some = cut[lo : lo + segments]
            at, valid = positions(firsts[some], sizes[some])
            matrix[lo : lo + segments] = self.passage(per_word[index[at]], valid, place[some] == 0)
        row = np.zeros(len(firsts), dtype=np.int64)
        row[cut] = np.arange(len(cut))
        # one step along all chains at a time, from the left and then from the right
        order = cut[np.argsort(place[cut], kind="stable")]
        for some in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            some = some[(some + 1 < len(chain)) & (chain[np.minimum(some + 1, len(chain) - 1)] == chain[some])]
            came = np.where((place[some] == 0)[:, None], 1 / k, before[some])
            out = np.einsum("nk,nkl->nl", came, matrix[row[some]])
            before[some + 1] = out / out.sum(axis=1, keepdims=True)
        for some in reversed(np.split(order, np.flatnonzero(np.diff(place[order])) + 1)):
            some = some[place[some] > 0]
            out = np.einsum("nkl,nl->nk", matrix[row[some]], after[some])
            after[some - 1] = out / out.sum(axis=1, keepdims=True)
        entered = np.where((place > 0)[:, None], before @ t, 1.0)
        for lo in range(0, len(firsts), segments):
            some = slice(lo, lo + segments)
            at, valid = positions(firsts[some], sizes[some])
            found, _ = self.marginals(per_word[index[at]], valid, entered[some], after[some])
            yield at[valid], found[valid]


def segmented(lengths: list[int], segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment of chains that lie one after another: its chain, its number there, its first word and its words."""
    n = np.array(lengths, dtype=np.int64)
    parts = -(-n // segment)
    chain = np.repeat(np.arange(len(n)), parts)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    return chain, place, (np.cumsum(n) - n)[chain] + place * segment, np.minimum(segment, n[chain] - place * segment)


def positions(firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (segments, words) of the segments' words, and which of them are real."""
    steps = np.arange(sizes.max() if len(sizes) else 1)
    valid = steps[None, :] < sizes[:, None]
    return np.where(valid, firsts[:, None] + steps[None, :], 0), valid


def numbered(lists: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """The distinct words of all lists, and the number of each word in order."""
    known: dict[str, int] = {}
    index = [known.setdefault(w, len(known)) for ws in lists for w in ws]
    return list(known), np.array(index, dtype=np.int64)


def fit(texts: list[str], langs: list[str], seed: int = SEED) -> Crf | None:
    """Fit by the likelihood's gradient (expected against given label counts) with per-weight step sizes."""
    rng = np.random.default_rng(seed)
    found = [(words_of(t), lang) for t, lang in zip(texts, langs, strict=True)]
    found = [(ws, lang) for ws, lang in found if ws]
    labels = sorted({lang for _, lang in found})
    if not labels:
        return None
    # splice pieces of random documents into chains; every document's words are used once
    pieces = []
    for ws, lang in found:
        at = 0
        while at < len(ws):
            size = int(rng.integers(*PIECE))
            pieces.append((ws[at : at + size], labels.index(lang)))
            at += size
    pieces = [pieces[k] for k in rng.permutation(len(pieces))]
    words, index = numbered([p for p, _ in pieces])
    truth = np.repeat([y for _, y in pieces], [len(p) for p, _ in pieces])
    counts = np.bincount(index, minlength=len(words))
    lexicon = {words[i]: k for k, i in enumerate(np.argsort(-counts, kind="stable")[:LEXICON]) if counts[i] > 1}
    f = Features.of(words, lexicon)
    k = len(labels)
    model = Crf(labels, np.zeros((1 << HASH_BITS, k)), np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)), lexicon)
    at, valid = positions(*segmented([len(index)])[2:])
    given = np.eye(k)[truth]
    empirical = np.zeros((k, k))
    y = truth[at]
    both = valid[:, 1:] & valid[:, :-1]
    np.add.at(empirical, (y[:, :-1][both], y[:, 1:][both]), 1)
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(f.starts, len(f.grams))))
    squares = [np.full_like(w, 1e-8) for w in (model.weights, model.lexical, model.transitions)]
    for _ in range(ROUNDS):
        marginals, pairs = model.marginals(model.emissions(f)[index][at], valid)
        expected = np.zeros_like(given)
        expected[at[valid]] = marginals[valid]
        per_word = np.stack([np.bincount(index, weights=(given - expected)[:, c], minlength=len(words)) for c in range(k)], axis=1)
        grams = np.stack([np.bincount(f.grams, weights=per_word[owner, c], minlength=1 << HASH_BITS) for c in range(k)], axis=1)
        lexical = np.stack([np.bincount(f.lexical % (len(lexicon) + 1), weights=per_word[:, c], minlength=len(lexicon) + 1) for c in range(k)], axis=1)
        for weights, gradient, square in zip((model.weights, model.lexical, model.transitions), (grams, lexical, empirical - pairs), squares, strict=True):
            gradient = gradient / len(index) - DECAY * weights / len(index)
            square += gradient * gradient
            weights += RATE * gradient / np.sqrt(square)
    model.weights, model.lexical = model.weights.astype(np.float32), model.lexical.astype(np.float32)
    return model


def label(model: Crf | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lists = [words_of(t) for t in texts]
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    words, index = numbered(lists)
    shares = np.zeros((len(texts), len(model.labels)))
    if words:
        lengths = [len(ws) for ws in lists]
        document = np.repeat(np.arange(len(texts)), lengths)
        scores = model.emissions(Features.of(words, model.lexicon)).astype(np.float64)
        for at, found in model.chain_marginals(scores, index, lengths):
            for c in range(len(model.labels)):
                shares[:, c] += np.bincount(document[at], weights=found[:, c], minlength=len(texts))
        shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
    best = shares.argmax(axis=1)
    names = [model.labels[b] if ws else UNKNOWN for b, ws in zip(best, lists, strict=True)]
    return names, [min(1.0, float(shares[r, b])) if lists[r] else 0.0 for r, b in enumerate(best)]


def runs(model: Crf | None, text: str | None) -> list[tuple[int, int, str, float]]:
    """Runs of a text's words whose most probable label is the same: first word, words, label, mean probability."""
    words, index = numbered([words_of(text)])
    if model is None or not words:
        return []
    found = np.empty((len(index), len(model.labels)))
    for at, part in model.chain_marginals(model.emissions(Features.of(words, model.lexicon)).astype(np.float64), index, [len(index)]):
        found[at] = part
    best = found.argmax(axis=1)
    edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
    return [(a, b - a, model.labels[best[a]], float(found[a:b, best[a]].mean())) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def train(df: DataFrame, is_training: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, seed: int = SEED) -> Crf | None:
    """Fit on labelled rows with is_training: the same number of each language, those with the least hashes of the id.

    That number is `rows` over the number of languages, but LANG_ROWS at least. Rows without a letter can't be drawn, so
    that every language with a text to learn from is among the model's labels, however rare it is and however long its
    texts are: of a text of more than TRAIN_CHARS characters so many are read, from a place given by a hash of the id, or
    from its first letter if there is none after that.
    """
    text = F.col(text_col).cast("string")
    known = df.select(F.col(id_col).alias("id"), text.alias("whole"), F.col(lang_col).cast("string").alias("lang"), is_training.alias("training"))
    known = known.filter(F.col("training") & F.col("lang").isNotNull() & F.col("whole").rlike(LETTER))
    start = F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest(F.length("whole") - TRAIN_CHARS + 1, F.lit(1)).cast("long")).cast("int") + 1
    passage = F.substring("whole", start, F.lit(TRAIN_CHARS))
    from_letter = F.substring("whole", F.regexp_instr("whole", F.lit(LETTER)), F.lit(TRAIN_CHARS))
    known = known.select("id", "lang", F.when(F.length("whole") <= TRAIN_CHARS, F.col("whole")).when(passage.rlike(LETTER), passage).otherwise(from_letter).alias("text"))
    # one row for each label of the model
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    most = max(LANG_ROWS, rows // len(counts))
    bounds = [(lang, (1 << 63) - 1 if n <= SPARE * most else int(-(1 << 63) + (1 << 64) * (SPARE * most / n))) for lang, n in counts.items()]
    bound = F.broadcast(df.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    hashed = known.withColumn("draw", F.xxhash64("id", F.lit(seed))).join(bound, "lang").filter("draw <= bound")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"), "text"))
    some = hashed.withColumn("place", place).filter(F.col("place") <= most)
    found = some.orderBy("draw", "text", "lang").select(F.col("text").alias("t"), F.col("lang").alias("l")).collect()
    return fit([r["t"] for r in found], [r["l"] for r in found], seed)


def identify(df: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, lang_pred, score, *carry), one per row of df. A text that is carried travels once."""
    broadcast, beside = df.sparkSession.sparkContext.broadcast(model), [c for c in carry if c != text_col]
    at = [1 if c == text_col else 2 + beside.index(c) for c in carry]

    def make():
        held = broadcast.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = label(held, batch.column(1).to_pylist())
            extra = [batch.column(k) for k in at]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *extra], ["id", "lang_pred", "score", *(f"x{k}" for k in range(len(carry)))])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"b{k}") for k, c in enumerate(beside)])
    kinds = "".join(f", x{k} {'string' if c == text_col else df.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = map_arrow(rows, make, f"id {kind}, lang_pred string, score double{kinds}", rows=128)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", *[F.col(f"x{k}").alias(c) for k, c in enumerate(carry)])


def switches(df: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start, words, lang, score): the runs of words of one language in each text, start counted in words."""
    broadcast = df.sparkSession.sparkContext.broadcast(model)

    def make():
        held = broadcast.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(r, *run) for r, text in enumerate(batch.column(1).to_pylist()) for run in runs(held, text)]
            row, start, words, lang, score = zip(*found, strict=True) if found else ((),) * 5
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(words, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "start", "words", "lang", "score"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, make, f"id {kind}, start long, words long, lang string, score double").withColumnRenamed("id", id_col)
