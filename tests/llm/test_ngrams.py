"""op12 and op13 against plain counting."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from splinebrook.llm import ngram_lm as M
from splinebrook.llm import ngrams, phrases, queries

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- op13 --------------------------------------------------------------------------------------------------------------


def slow_collocations(docs, top, least):
    """docs (lang, text) -> the contract's rows, all phrases counted."""
    counts, totals = {}, Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for size in range(1, 5):
                for at in range(len(words) - size + 1):
                    counts.setdefault("und" if lang is None else lang, Counter())[tuple(words[at : at + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for q, a in candidates.items():
            for size in range(2, len(q)):
                gone |= {p for p in (q[at : at + size] for at in range(len(q) - size + 1)) if 100 * a >= 80 * f[p]}
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out += [(lang, k + 1, p.decode(), -a, left, right, totals[lang], -s) for k, (s, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def chatter():
    """Skewed words, a passage that many texts share, nulls, marks and spaces of every kind, a language with a third of everything."""
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(40)] + ["É", "ß", "x\x00y", "Σ"]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for k in range(260):
        text = " ".join(rng.choice(words, rng.integers(0, 60), p=weights / weights.sum()))
        if k % 3 == 0:
            text += ". The Same  passage\tof seven words here, " + "again and again " * (k % 4)
        rows.append((["en", "en", None, "de", ""][k % 5], text.replace("w3 ", "w3! ").replace("w5 ", "w5\x0b")))
    return [*rows, ("en", None), (None, ""), ("fr", " \t\n.,"), ("en", "one" + " two" * 3000)]


@pytest.mark.parametrize(("top", "least"), [(3, 2), (25, 3), (100_000, 4)])
def test_collocations_against_plain_counting(spark, chatter, top, least):
    df = spark.createDataFrame([(*r, 5, "k") for r in chatter], "lang string, text string, n long, phrase string")
    assert found(phrases.collocations(df, top, least)) == slow_collocations(chatter, top, least)


def test_bounds_prune(spark, chatter, monkeypatch):
    """With a small top most phrases are never opened, and the result is that of opening all."""
    opened = []
    monkeypatch.setattr(phrases, "members", lambda df: opened.append(df.count()) or ngrams.members(df))
    df = spark.createDataFrame(chatter, "lang string, text string")
    few = found(phrases.collocations(df, 2, 3))
    pruned, opened[:] = sum(opened[2:]), []
    every = found(phrases.collocations(df, 100_000, 3))
    assert pruned < sum(opened[2:]) / 2 and few == [r for r in every if r[1] <= 2]


def test_whole_query_op13(spark, sf, docs):
    want = slow_collocations([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 2000, 30)
    assert found(queries.op13_phrases(spark, sf)) == want and want


def test_odd_texts_op13(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()]
    assert found(phrases.collocations(odd_docs, 50, 1)) == slow_collocations(rows, 50, 1)
    assert found(phrases.collocations(no_docs)) == []


def test_products_beyond_64_bits(spark):
    n = 10**13
    facts = spark.createDataFrame([("en", "a", 2 * n), ("en", "b", 3 * n)], "lang string, phrase string, a long")
    one = spark.createDataFrame([("en", "a b", 2, n + 1)], "lang string, phrase string, size int, a long")
    assert phrases.scored(one, facts).first().score == 2_000_000 * (n + 1) // (5 * n)


def test_long_pieces_are_cut_at_their_ends():
    data = b"a b\n" * 10 + b"c" * 50 + b"\nd"
    parts = list(ngrams.windows(data, 8))
    assert b"".join(parts) == data and all(p.endswith(b"\n") for p in parts[:-1]) and max(map(len, parts)) < 60


# --- op12 --------------------------------------------------------------------------------------------------------------


def tokens_of(text):
    return [*re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def size_of(count):
    return math.floor(math.log(count) / math.log(2.0) * M.STEPS)


def least_size(counts, most):
    sizes, total, least = Counter(size_of(c) for c in counts if c > 0), 0, M.BUCKETS * M.STEPS
    for size in sorted(sizes, reverse=True):
        total += sizes[size]
        if total > most:
            break
        least = size
    return least


def slow_model(rows, vocabulary):
    """rows (text, kind) -> (base, score) of each, with dictionaries."""
    texts = [tokens_of(t) for t, _ in rows]
    count, kept = Counter(), Counter()
    for words, (_, kind) in zip(texts, rows, strict=True):
        if kind != M.OTHER:
            count.update(words)
        if kind == M.KEPT:
            kept.update(words)
    total, different, kept_total = sum(count.values()), len(count), sum(kept.values())
    least = least_size(count.values(), vocabulary)
    own = {w for w, c in count.items() if size_of(c) >= least or w == "\n"}
    kinds = len(own) + 1

    def pairs(words):
        named = [w if w in own else None for w in words]
        return list(zip(["<s>", *named[:-1]], named, strict=True))

    tallies = []
    for wanted in ((M.KEPT,), (M.DELETED,), (M.KEPT, M.DELETED)):
        some = [w for w, (_, kind) in zip(texts, rows, strict=True) if kind in wanted]
        pair, single = Counter(p for w in some for p in pairs(w)), Counter(x if x in own else None for w in some for x in w)
        single["<s>"] = len(some)
        tallies.append((pair, single))
    (kept_pairs, kept_single), (deleted, _), (all_pairs, single) = tallies

    def parts(pair, pair_counts, counts, n):
        context, token = pair
        seen = counts[context]
        return seen.bit_length(), 1 / kinds, counts[token] / max(n, 1), pair_counts[pair] / max(seen, 1)

    held = [(*parts(p, kept_pairs, kept_single, kept_total), n) for p, n in deleted.items()]
    weights, before = {b: (1 / 3,) * 3 for b in range(M.BUCKETS)}, -math.inf
    for _ in range(M.ROUNDS):
        sums, after = {}, 0.0
        for b, *p, n in held:
            mixed = [w * x for w, x in zip(weights[b], p, strict=True)]
            after += n * math.log(sum(mixed))
            sums[b] = [s + n * m / sum(mixed) for s, m in zip(sums.get(b, (0, 0, 0)), mixed, strict=True)]
        whole = [sum(s[k] for s in sums.values()) for k in range(3)] if sums else [1, 1, 1]
        prior = [(x + 1) / (sum(whole) + 3) for x in whole]
        weights = {b: tuple((s + p) / (sum(sums[b]) + 1) for s, p in zip(sums[b], prior, strict=True)) if b in sums else tuple(prior) for b in range(M.BUCKETS)}
        if abs(after - before) <= M.TOLERANCE * abs(after):
            break
        before = after
    rare = sum(c for w, c in count.items() if w not in own) + different - len(own) + 1
    out = []
    for words in texts:
        base = sum(math.log10((count[w] + 1) / (total + different + 1)) for w in words)
        score = sum(math.log10((count[w] + 1) / rare) for w in words if w not in own)
        for p in pairs(words):
            b, *x = parts(p, all_pairs, single, total)
            score += math.log10(sum(w * v for w, v in zip(weights[b], x, strict=True)))
        out.append((len(words), sum(count[w] > 0 for w in words), total, base, score))
    return out


def by_id(df):
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in df.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize(("vocabulary", "pairs"), [(1 << 17, 1 << 19), (60, 20)])
def test_model_against_dictionaries(docs, vocabulary, pairs):
    """With few broadcast words and pairs nearly everything goes through the buckets."""
    train = queries.remainder(F.col("doc_id"), 7) != 2
    rows = M.marked(docs, train, "doc_id", "text", F.col("doc_id")).collect()
    want = [(r.doc_id, *s) for r, s in zip(rows, slow_model([(r.text, r.kind) for r in rows], vocabulary), strict=True)]
    model = M.train_model(docs, train, vocabulary=vocabulary, pairs=pairs, least_pair=2)
    assert len(model.words.value.spelling) <= 2 * vocabulary + 1 and len(model.pairs.value[0]) <= pairs
    close(by_id(M.score(docs, model, train)), want)


def test_whole_query_op12(spark, sf, docs):
    got = queries.op12_ngram_lm(spark, sf)
    rows = docs.select("doc_id", "text").collect()
    assert {r.doc_id: r.held_out for r in got.select("doc_id", "held_out").collect()} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    marked = M.marked(docs, queries.remainder(F.col("doc_id"), 7) != 2, "doc_id", "text", F.col("doc_id")).collect()
    close(by_id(got), [(r.doc_id, *s) for r, s in zip(marked, slow_model([(r.text, r.kind) for r in marked], M.VOCABULARY), strict=True)])
    held = got.filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > held[0]  # of texts that were not learned from


def test_odd_texts_op12(odd_docs, no_docs):
    """Null, empty, blank and repeated rows, a null id (not learned from), an extra column of every name that is used inside."""
    train = queries.remainder(F.col("doc_id"), 7) != 2
    rows = M.marked(odd_docs, train, "doc_id", "text", F.col("doc_id")).collect()
    want = [(-1 if r.doc_id is None else r.doc_id, *s) for r, s in zip(rows, slow_model([(r.text, r.kind) for r in rows], 4), strict=True)]
    close(by_id(M.score(odd_docs, M.train_model(odd_docs, train, vocabulary=4, pairs=2, least_pair=1), train)), want)
    assert [r.kind for r in rows if r.doc_id is None] == [M.OTHER]
    assert M.score(no_docs, M.train_model(no_docs, train), train).count() == 0


def test_nothing_to_learn_from(odd_docs):
    never = F.lit(False)
    for r in M.score(odd_docs, M.train_model(odd_docs, never), never).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score == 0


def test_probabilities_add_up(docs):
    """After a context the classes' probabilities add up to 1, and so do the rarer words' shares with that of unseen ones."""
    model = M.train_model(docs, F.lit(True), vocabulary=300, pairs=10)
    words = model.words.value
    tallies, seen = Counter(), Counter()
    place = {w: k for k, w in enumerate(words.spelling.to_pylist())}
    for r in docs.select("text").collect():
        named = [int(words.classes[place[w]]) if w in place else words.rare for w in tokens_of(r.text)]
        tallies.update(zip([words.start, *named[:-1]], named, strict=True))
        seen.update(w for w in tokens_of(r.text) if w not in place or not words.own[place[w]])
    classes = np.array([*np.flatnonzero(words.own), words.rare])
    for context in (words.start, words.rare, int(classes[5])):
        pair = np.array([tallies[context, int(c)] for c in classes])
        assert (10 ** words.probability(model.weights, np.full(len(classes), context), classes, pair)).sum() == pytest.approx(1)
    assert (10 ** words.share(np.array(list(seen.values())))).sum() + 1 / words.rare_places == pytest.approx(1)


def test_packed_numbers_come_back():
    for numbers in (np.array([3, 9, 9, 2**20]), np.array([5, 2**40, 2**41 + 1]), np.array([], dtype=np.int64)):
        assert M.unpacked(M.packed(numbers), len(numbers)).tolist() == numbers.tolist()
