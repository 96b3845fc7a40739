"""Toxicity by a weighted finite-state pattern grammar.

A clause is a string of words, and the grammar a cascade of transducers composed into one: what one puts out is what the
next one reads. The lexical transducer turns words into insult, threat verb, intent, target, negation, reported speech,
contrast or other, with a weight on each arc. The negation transducer marks what a negation reaches, the threat transducer
keeps those threat verbs that an intent precedes, the report transducer marks what is reported up to a contrast, and the
target transducer, which has to guess and is held to its guess at the clause's end, marks what is aimed at someone. The
last tape holds the kinds of match; arcs of the kinds carry the learned weights that score a document by its matched
clauses, not by its words.

The insult lexicon (words, and stems that several such words share) is learned from labelled documents: what is found in
clearly more toxic than clean ones, counted once for each group of near copies. The weights of the kinds of match are
learned by logistic regression, pulled towards what the grammar means. Ids that are labelled both ways are not learned
from; a label that is repeated counts once.

Null and empty texts hold no match and get the base score, as all texts without a match do. Texts are read whole, however
long; repeated rows each get their score; an empty table gives no rows. Without labels to learn from the prior weights and
the fixed word lists decide.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw, map_arrow

#: Labelled rows that are learned from, at most, of each label.
TRAIN_TOXIC = 8_000
TRAIN_CLEAN = 12_000
PREDICT_AT = 0.7
SEED = 11
#: A lexicon entry is in this share of toxic documents at least, and in so many (groups of copies count once).
MIN_SHARE = 0.005
MIN_DOCUMENTS = 4
#: Clean documents that hold it, for each toxic one, at most; and its log odds, at least.
MAX_CLEAN = 0.1
MIN_ODDS = 2.0
STEMS = (4, 5)
#: Letters of a word that two unrelated texts seldom share.
LONG = 8
#: Different words of the lexicon that a stem is made of, at least.
STEM_WORDS = 3
#: Words after a negation that it reaches.
NEGATION_REACH = 3

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n…]+")

#: Fixed word lists of the grammar in English, German, French and Spanish.
TARGETS = frozenset("you your yours you're youre u ur he she they him her them his their du dich dir dein deine ihr euch sie tu toi te vous votre vos il elle ils tú ti tus usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't didn't won't nobody nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says say called calls quoted quotes claimed claims wrote writes reported alleged sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split())
INTENTS = frozenset("will gonna going shall 'll i'll we'll werde werden vais va allons voy vamos".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn murder strangle töten umbringen schlagen verletzen tuer frapper brûler blesser matar golpear quemar herir".split())

CONTRASTS = frozenset("but however although though aber doch jedoch mais pourtant pero sino aunque".split())

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, CONTRAST = "other insult threat intent target negation report contrast".split()
MATCHES = (INSULT, THREAT)
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat", "negated threat", "reported threat")
#: What the kinds mean before any label is seen: bias, then one weight for each kind.
PRIOR = np.array([-3.0, 6.0, 1.0, 1.5, 2.0, 4.0, 1.5, 0.5, 1.0])

#: (next state, output, weight)
Arc = tuple[object, str, float]


@dataclass(frozen=True)
class Transducer:
    """States and arcs; arcs(state, symbol) may be several, and a string is accepted where it ends in a final state."""

    start: tuple
    arcs: Callable[[object, str], tuple[Arc, ...]]
    final: Callable[[object], bool] = lambda state: True


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what first reads and puts out what second makes of what first puts out; weights multiply."""

    @functools.lru_cache(maxsize=4096)
    def arcs(state, symbol):
        return tuple(((a, b), out, x * y) for a, middle, x in first.arcs(state[0], symbol) for b, out, y in second.arcs(state[1], middle))

    return Transducer(tuple((a, b) for a in first.start for b in second.start), arcs, lambda state: first.final(state[0]) and second.final(state[1]))


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """Marks matches that a negation reaches; a second negation within reach undoes the first, a contrast ends it."""

    def arcs(state, symbol):
        if symbol == NEGATION:
            return ((0 if state else reach + 1, OTHER, 1.0),)
        marked = f"negated {symbol}" if state > 0 and symbol in MATCHES else symbol
        return ((0 if symbol == CONTRAST else max(0, state - 1), marked, 1.0),)

    return Transducer((0,), arcs)


def threats() -> Transducer:
    """Keeps threat verbs after an intent in the clause, negated or not; others are words like any other."""

    def arcs(state, symbol):
        if symbol == INTENT:
            return ((1, OTHER, 1.0),)
        return ((state, symbol if state or not symbol.endswith(THREAT) else OTHER, 1.0),)

    return Transducer((0,), arcs)


def reports() -> Transducer:
    """Marks matches between a verb of speech and the next contrast; what is negated stays so."""

    def arcs(state, symbol):
        if symbol in (REPORT, CONTRAST):
            return ((int(symbol == REPORT), OTHER, 1.0),)
        return ((state, f"reported {symbol}" if state and symbol in MATCHES else symbol, 1.0),)

    return Transducer((0,), arcs)


def targets() -> Transducer:
    """Marks matches of a clause that names a target anywhere: it guesses, and a wrong guess is not accepted."""

    def arcs(state, symbol):
        guess, seen = state
        seen = seen or symbol == TARGET
        out = OTHER if symbol == TARGET else f"aimed {symbol}" if guess and symbol in MATCHES else symbol
        return (((guess, seen), out, 1.0),)

    return Transducer(((True, False), (False, False)), arcs, lambda state: state[0] == state[1])


def grammar(without: str = "") -> Transducer:
    """The cascade from symbols to kinds of match; without: the name of a transducer to leave out."""
    parts = [make() for make in (negation, threats, reports, targets) if make.__name__ != without]
    return functools.reduce(compose, parts)


def accepted(machine: Transducer, symbols: Iterable[str]) -> np.ndarray:
    """Weights of the matches on the one accepted path, summed by kind."""
    paths = {state: np.zeros(len(KINDS)) for state in machine.start}
    for symbol in symbols:
        ahead = {}
        for state, found in paths.items():
            for after, out, weight in machine.arcs(state, symbol):
                kind = KIND_OF.get(out)
                if kind is not None:
                    found = found.copy()
                    found[kind] += weight
                ahead[after] = found
        paths = ahead
    return next(found for state, found in paths.items() if machine.final(state))


KIND_OF = {kind: k for k, kind in enumerate(KINDS)}


@functools.lru_cache(maxsize=1)
def grammar_of_process() -> Transducer:
    return grammar()


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray

    def lexical(self) -> Transducer:
        """One state, and an arc for each word."""
        return Transducer((0,), lambda state, word: ((0, *self.symbol(word)),))

    def symbol(self, word: str) -> tuple[str, float]:
        weight = self.words.get(word)
        if weight is None:
            for n in STEMS:
                weight = self.stems.get(word[:n]) if len(word) > n else None
                if weight is not None:
                    break
        if weight is not None:
            return INSULT, weight
        for symbol, listed in ((NEGATION, NEGATIONS), (TARGET, TARGETS), (REPORT, REPORTS), (INTENT, INTENTS), (THREAT, THREATS), (CONTRAST, CONTRASTS)):
            if word in listed:
                return symbol, 1.0
        return OTHER, 1.0

    def matches(self, text: str | None, cascade: Transducer | None = None) -> np.ndarray:
        """Summed weights of the matched clauses, for each kind."""
        out = np.zeros(len(KINDS))
        if not text:
            return out
        text = text.lower()
        telling = {w for w in set(WORD.findall(text)) if self.symbol(w)[0] in MATCHES}
        if not telling:
            return out
        machine = compose(self.lexical(), cascade or grammar_of_process())
        for clause in CLAUSE.split(text):
            words = WORD.findall(clause)
            if not telling.isdisjoint(words):
                out += accepted(machine, words)
        return out

    def score(self, matches: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + saturated(matches) @ self.weights[1:])))


def terms(text: str | None) -> set[str]:
    """The words of a text, and its stems written with a closing hyphen."""
    words = set(WORD.findall((text or "").lower()))
    return words | {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}


def copy_key(text: str | None) -> int:
    """Equal for copies and mostly for near copies: the least hash of the long words, or of all where none is long."""
    words = set(WORD.findall((text or "").lower()))
    return min(map(xxhash.xxh64_intdigest, {w for w in words if len(w) >= LONG} or words), default=0) >> 1


def learn_lexicon(labelled: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """labelled: (text, toxic). Words and stems with their weights, learned from counts over all these rows."""

    def found(batches):
        for batch in batches:
            keys, listed = [], []
            for text in batch.column(0).to_pylist():
                own = terms(text)
                listed += own
                keys += [copy_key(text)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(listed, pa.string()), pa.array(keys, pa.int64())], ["term", "copy"])

    def keys_only(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([copy_key(t) for t in batch.column(0).to_pylist()], pa.int64())], ["copy"])

    toxic, clean = labelled.filter("toxic = 1").select("text"), labelled.filter("toxic = 0").select("text")
    n_toxic = toxic.mapInArrow(keys_only, "copy long").distinct().count()
    n_clean = clean.count()
    least = max(MIN_DOCUMENTS, math.ceil(MIN_SHARE * n_toxic))
    per_term = toxic.mapInArrow(found, "term string, copy long").groupBy("term").agg(F.count_distinct("copy").alias("n")).filter(F.col("n") >= least)
    in_toxic = {r["term"]: r["n"] for r in per_term.collect()}  # at most 1 / MIN_SHARE times a text's terms

    def counted(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(terms(text) & in_toxic.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    in_clean = {r["term"]: r["n"] for r in clean.mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    odds = {}
    for term, t in in_toxic.items():
        c = in_clean.get(term, 0)
        value = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        if c <= MAX_CLEAN * t and value >= MIN_ODDS:
            odds[term] = value
    words = {w: v for w, v in odds.items() if not w.endswith("-")}
    members = Counter(w[:n] for w in words for n in STEMS if len(w) > n)
    stems = {s[:-1]: v for s, v in odds.items() if s.endswith("-") and members[s[:-1]] >= STEM_WORDS}
    # around 1, so that they stand for evidence and not for the size of the sample
    middle = float(np.median([*words.values(), *stems.values()])) if odds else 1.0
    weight = lambda v: min(1.5, max(0.5, v / middle))
    return {w: weight(v) for w, v in words.items()}, {s: weight(v) for s, v in stems.items()}


def saturated(matches: np.ndarray) -> np.ndarray:
    """Kinds as they are weighed: what is aimed is an insult or a threat, and more. The first match counts most; many approach 1."""
    matches = matches.copy()
    matches[:, 0] += matches[:, 1]
    matches[:, 4] += matches[:, 5]
    return 1 - np.exp(-4 * matches)


def learn_weights(matches: np.ndarray, labels: np.ndarray, pull: float = 2.0, rounds: int = 300) -> np.ndarray:
    """Logistic regression by Newton's method with bounded steps, pulled towards PRIOR."""
    x = np.hstack([np.ones((len(matches), 1)), saturated(matches)])
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (p - labels) + pull * (w - PRIOR)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull * np.eye(len(w)), gradient)
        step /= max(1.0, np.abs(step).max())
        new = np.r_[w[:1] - step[:1], np.maximum(w[1:] - step[1:], 0)]  # no kind of match speaks for a text
        step, w = new - w, new
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, is_training: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = SEED) -> Model:
    """Learn from at most TRAIN_TOXIC and TRAIN_CLEAN labelled rows with is_training (over the id), drawn by a hash of it."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    known = known.join(docs.select(F.col(id_col).alias("id")).filter(is_training(F.col("id"))).distinct(), "id", "left_semi")
    known = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("id", "toxic")
    drawn = [draw(known.filter(F.col("toxic") == value), most, F.col("id"), seed) for value, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    # at most 20 000 rows of two numbers
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "id").select("text", "toxic").persist()
    try:
        words, stems = learn_lexicon(labelled)
        model = Model(words, stems, PRIOR)

        def features(batches):
            for batch in batches:
                found = np.array([model.matches(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(KINDS))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(1).to_numpy().astype(float)), *(pa.array(found[:, k]) for k in range(len(KINDS)))], ["y", *(f"k{k}" for k in range(len(KINDS)))])

        schema = "y double, " + ", ".join(f"k{k} double" for k in range(len(KINDS)))
        rows = labelled.mapInArrow(features, schema).toArrow()
    finally:
        labelled.unpersist()
    table = np.array([np.asarray(rows.column(c)) for c in range(rows.num_columns)]).T.reshape(-1, 1 + len(KINDS))
    order = np.lexsort(table.T)
    model.weights = learn_weights(table[order, 1:], table[order, 0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", predict_at: float = PREDICT_AT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, score, predicted, *carry), one per row of docs. A text that is carried travels once."""
    broadcast, beside = docs.sparkSession.sparkContext.broadcast(model), [c for c in carry if c != text_col]
    at = [1 if c == text_col else 2 + beside.index(c) for c in carry]

    def make():
        held = broadcast.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = held.score(np.array([held.matches(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(KINDS)))
            extra = [batch.column(k) for k in at]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= predict_at).astype(np.int32)), *extra], ["id", "score", "predicted", *(f"x{k}" for k in range(len(carry)))])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"b{k}") for k, c in enumerate(beside)])
    kinds = "".join(f", x{k} {'string' if c == text_col else docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = map_arrow(rows, make, f"id {kind}, score double, predicted int{kinds}")
    return out.select(F.col("id").alias(id_col), "score", "predicted", *[F.col(f"x{k}").alias(c) for k, c in enumerate(carry)])
