"""Nested cross-validation, permutation tests and importances of pair classifiers over features that stay on the cluster.

A study has few subjects and may have very many features, and very many fits. The models here scale their features, keep those
with the largest F statistics and fit a linear classifier, each within its own training rows: a bag, in a fold, for a
permutation. So features are dealt out by columns, and three steps follow:

1. every block of columns works out the F statistic, mean and deviation of its features for every fit, as products of the fits'
   row weights with the block, and hands on its best; a window keeps each fit's k best over all blocks;
2. a unit of work, the bags of one training set or of several, gets each column that any of its fits chose once, unscaled;
3. each fit scales its k columns and scores the rows that it has not seen. A unit adds up its bags' scores itself, and where only
   accuracies are asked for it hands on counts.

What a row is in a fit follows from its place: places number a pair's rows by class, and then by the MD5 of the id. A place's fold is
its number within its class modulo the folds, its inner fold likewise among the rows left. Under permutation k the subject at
a place plays the part of the place that permutation.permuted moves it to, label and folds together. Bags draw as many rows
from each class, with replacement, as the smaller one has. Nothing of the size of fits times rows is stored.

Memory: a block's task holds its columns for all rows, and row weights of so many fits as CELLS numbers allow; a unit holds the
columns that its fits chose, of one training set's bags at least. Features of null or no label are left out.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .learning import Logistic, LinearSvm
from .permutation import permuted
from .rsa import seed_of
from .scratch import Steps

BLOCK = 64
#: Fits of one chunk of a block's work, and numbers in their row weights that are multiplied with the block together.
TOGETHER, CELLS = 256, 1 << 21
BAGS, INNER = 30, 3
#: Units of work for each pair at most where its columns are few, and bytes of columns that a unit of several training sets may hold.
UNITS, UNIT_BYTES = 64, 1 << 26
MODELS = {"LR": Logistic, "SVM": LinearSvm}


@dataclass(frozen=True)
class Parts:
    """What each place of a pair does: class, outer fold, and inner fold for each outer fold left out."""

    zeros: int
    ones: int
    k: int

    @property
    def n(self) -> int:
        return self.zeros + self.ones

    def classes(self) -> np.ndarray:
        return (np.arange(self.n) >= self.zeros).astype(int)

    def dealt(self, left: np.ndarray, k: int) -> np.ndarray:
        """Fold of each place among those left; each its own where the smaller class has fewer than k. -1 elsewhere."""
        y, out = self.classes(), np.full(self.n, -1)
        if min(np.bincount(y[left], minlength=2)) < k:
            out[left] = np.arange(left.sum())
            return out
        for c in (0, 1):
            own = np.flatnonzero(left & (y == c))
            out[own] = np.arange(len(own)) % k
        return out

    def outer(self) -> np.ndarray:
        return self.dealt(np.ones(self.n, dtype=bool), self.k)

    def trains(self, fold: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
        """(training, unseen) places of an outer fold, or of an inner fold within it; fold -1 leaves nothing out."""
        return trained(self, fold, inner)


@functools.lru_cache(4096)
def trained(parts: Parts, fold: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    left = np.ones(parts.n, dtype=bool) if fold < 0 else parts.outer() != fold
    if inner < 0:
        return left, ~left
    within = parts.dealt(left, INNER)
    return left & (within != inner), left & (within == inner)


def bagged(y: np.ndarray) -> bool:
    """Ensembles need 20 rows and 7 of the smaller class."""
    return len(y) >= 20 and np.bincount(y, minlength=2).min() >= 7


#: permutation (0: the labels as they are), outer fold (-1: none), inner fold (-1: none), bag (-1: one plain fit)
Fit = tuple[int, int, int, int]


def fits_of(parts: Parts, permutations: list[int], nested: bool, outer: bool = True) -> list[Fit]:
    out = []
    y = parts.classes()
    for fold in np.unique(parts.outer()).tolist() if outer else [-1]:
        left, _ = parts.trains(fold, -1)
        for inner in np.unique(parts.dealt(left, INNER)[left]).tolist() if nested else [-1]:
            train, _ = parts.trains(fold, inner)
            bags = range(BAGS) if bagged(y[train]) else [-1]
            out += [(k, fold, inner, bag) for k in permutations for bag in bags]
    return out


def row_weights(pair: str, parts: Parts, fit: Fit, seed: int) -> np.ndarray:
    """How often each place (of the parts that are played) is in the fit's training rows."""
    k, fold, inner, bag = fit
    train, _ = parts.trains(fold, inner)
    if bag < 0:
        return train.astype(float)
    y, rng, out = parts.classes(), np.random.default_rng(seed_of(pair, k, fold, inner, bag, seed)), np.zeros(parts.n)
    least = np.bincount(y[train], minlength=2).min()
    for c in (0, 1):
        out += np.bincount(rng.choice(np.flatnonzero(train & (y == c)), least, replace=True), minlength=parts.n)
    return out


def played(parts: Parts, k: int, seed: int) -> np.ndarray:
    """The part that the subject at each place plays."""
    return np.arange(parts.n) if k == 0 else permuted(np.arange(parts.n), parts.n, 0, np.array([k]), seed)[0]


def f_statistics(x: np.ndarray, w: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fit (row of the weights w, with the rows of class 1 marked in `one`) and feature: F, mean and deviation."""
    shift = x.mean(axis=0)
    x = x - shift
    sums, squares = [], w @ (x * x)
    for part in (w * (1 - one), w * one):
        sums.append((part.sum(axis=1, keepdims=True), part @ x))
    (n0, s0), (n1, s1) = sums
    n = n0 + n1
    mean = (s0 + s1) / n
    between = s0 * s0 / np.maximum(n0, 1) + s1 * s1 / np.maximum(n1, 1) - n * mean * mean
    within = squares - n * mean * mean - between
    floor = 1e-12 * np.maximum(squares, 1e-300)
    f = np.divide(between * (n - 2), within, out=np.where(between > floor, np.inf, 0.0), where=within > floor)
    return f, mean + shift, np.sqrt(np.maximum(squares / n - mean * mean, 0))


def study(features: DataFrame, labels: DataFrame, folds: int, key: str = "id", column: str = "x") -> tuple[DataFrame, DataFrame, dict[str, Parts]]:
    """features (key, x), labels (pair, key, y) -> columns (pair, block, feature, x, a value for each place), places (pair, place, id, y),
    parts of each pair. A pair needs two rows of each class."""
    known = labels.filter(F.col("y").isin(0, 1)).join(features.select(key), key, "left_semi")
    place = F.row_number().over(Window.partitionBy("pair").orderBy("y", F.md5(F.col(key).cast("string")), key)) - 1
    places = known.select("pair", place.alias("place"), F.col(key).alias("id"), "y")
    sizes = {r[0]: (r[1], r[2]) for r in places.groupBy("pair").agg(F.sum(1 - F.col("y")), F.sum("y")).collect()}  # a row a pair
    parts = {p: Parts(int(a), int(b), folds) for p, (a, b) in sizes.items() if min(a, b) > 1}
    places = places.filter(F.col("pair").isin(list(parts)))
    cut = F.transform(F.sequence(F.lit(0), F.size("x") - 1, F.lit(BLOCK)), lambda s: F.struct((s / BLOCK).cast("int").alias("block"), F.slice("x", s + 1, BLOCK).alias("v")))
    rows = features.select(F.col(key).alias("id"), F.col(column).alias("x")).filter("size(x) > 0").join(places.select("pair", "place", "id"), "id")

    def turn(frame: pd.DataFrame) -> pd.DataFrame:
        pair, block = frame["pair"].iloc[0], int(frame["block"].iloc[0])
        values = np.array(frame["v"].tolist())
        x = np.zeros((values.shape[1], parts[pair].n))
        x[:, frame["place"].to_numpy()] = values.T
        return pd.DataFrame({"pair": pair, "block": block, "feature": block * BLOCK + np.arange(len(x)), "x": list(x)})

    blocks = rows.select("pair", "place", F.explode(cut).alias("c")).select("pair", "place", "c.block", "c.v")
    return blocks.groupBy("pair", "block").applyInPandas(turn, "pair string, block int, feature int, x array<double>"), places, parts


def dealt(df: DataFrame, units: int, *keys: str) -> DataFrame:
    """df by its keys, in so many partitions that units of long work do not wait for each other."""
    return df.repartition(max(1, min(units, 4 * df.sparkSession.sparkContext.defaultParallelism)), *keys)


def units_of(parts: dict[str, Parts], fits: dict[str, list[Fit]], width: int) -> dict[str, np.ndarray]:
    """The unit of each fit: all bags of a training set are in one, and several training sets where their columns are small."""
    out = {}
    for pair, own in fits.items():
        cell = np.cumsum([a[:3] != b[:3] for a, b in zip(own, own[:1] + own[:-1], strict=True)])
        many = -(-(int(cell[-1]) + 1) // UNITS) if width * parts[pair].n * 8 <= UNIT_BYTES else 1
        out[pair] = cell // many
    return out


CHOSEN = "pair string, fit int, unit int, feature int, f double, mean double, sd double"


def chosen_features(columns: DataFrame, parts: dict[str, Parts], fits: dict[str, list[Fit]], units: dict[str, np.ndarray], k: int, seed: int) -> DataFrame:
    """Rows (pair, fit, unit, feature, f, mean, sd, rank): the k features with the largest F statistics; the first on ties."""

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        pair, chunk = frame["pair"].iloc[0], int(frame["chunk"].iloc[0])
        frame = frame.sort_values("feature")
        x, own, y, out = np.array(frame["x"].tolist()).T, parts[pair], parts[pair].classes(), []
        step, stop = max(1, CELLS // own.n), min((chunk + 1) * TOGETHER, len(fits[pair]))
        roles = {}
        for at in range(chunk * TOGETHER, stop, step):
            some = fits[pair][at : min(at + step, stop)]
            roles = {p: roles[p] if p in roles else played(own, p, seed) for p in {f[0] for f in some}}
            w = np.array([row_weights(pair, own, f, seed)[roles[f[0]]] for f in some])
            one = np.array([y[roles[f[0]]] for f in some])
            f, mean, sd = f_statistics(x, w, one)
            order = np.argsort(-f, axis=1, kind="stable")[:, :k]
            rows = np.arange(len(some))[:, None]
            fit = np.repeat(np.arange(at, at + len(some)), order.shape[1])
            out.append(pd.DataFrame({"pair": pair, "fit": fit, "unit": units[pair][fit], "feature": frame["feature"].to_numpy()[order].ravel(), "f": f[rows, order].ravel(), "mean": mean[rows, order].ravel(), "sd": sd[rows, order].ravel()}))
        return pd.concat(out)

    chunks = [(p, c) for p, own in fits.items() for c in range(-(-len(own) // TOGETHER))]
    work = columns.join(F.broadcast(columns.sparkSession.createDataFrame(chunks or [("", 0)], "pair string, chunk int")), "pair")
    found = dealt(work, len(chunks), "pair", "block", "chunk").groupBy("pair", "block", "chunk").applyInPandas(best, CHOSEN)
    order = Window.partitionBy("pair", "fit").orderBy(F.desc(F.round("f", 9)), "feature")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def by_unit(columns: DataFrame, chosen: DataFrame, units: dict[str, np.ndarray], work, schema: str) -> DataFrame:
    """work(chosen rows, columns) of each unit, with the columns that its fits chose, once each."""
    needed = chosen.select("pair", "unit", "feature").distinct().join(columns.select("pair", "feature", "x"), ["pair", "feature"])
    needed = needed.select(F.col("pair").alias("of_pair"), F.col("unit").alias("of_unit"), F.col("feature").alias("of_feature"), "x")
    n = sum(len(np.unique(u)) for u in units.values())
    left, right = (dealt(df, n, *keys).groupBy(*keys) for df, keys in ((chosen, ("pair", "unit")), (needed, ("of_pair", "of_unit"))))
    return left.cogroup(right).applyInPandas(work, schema)


SCORES = "pair string, ml_model string, permutation int, fold int, at int, place int, y int, score double"
HITS = "pair string, ml_model string, permutation int, fold int, at int, y int, n long, hits long"


def scores(columns: DataFrame, chosen: DataFrame, parts: dict[str, Parts], fits: dict[str, list[Fit]], units: dict[str, np.ndarray], model: str, grids: dict[str, list[dict]], seed: int, counted: bool) -> DataFrame:
    """What the fits say of the rows they have not seen, for every entry of the pair's grid, averaged over bags; or, if counted, how
    many rows of each class and training set there are, and how many of them are told right."""

    def fit(picked: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        pair, out = picked["pair"].iloc[0], []
        mine, x = parts[pair], dict(zip(frame["of_feature"], frame["x"], strict=True))
        by_fit = dict(list(picked.groupby("fit")))
        cells: dict[tuple, list[int]] = {}
        for number in sorted(by_fit):
            cells.setdefault(fits[pair][number][:3], []).append(number)
        for (k, fold, inner), numbers in cells.items():
            role = played(mine, k, seed)
            unseen = np.flatnonzero(mine.trains(fold, inner)[1][role])
            y = mine.classes()[role][unseen]
            sums = np.zeros((len(grids[pair]), len(unseen)))
            for number in numbers:
                for at, (m, z) in enumerate(fitted(by_fit[number], x, pair, mine, fits[pair][number], role, model, grids[pair], seed)):
                    sums[at] += m.score(z[unseen])
            # the order of a sum must not decide a score on the edge
            for at, score in enumerate(np.round(sums / len(numbers), 12)):
                same = {"pair": pair, "ml_model": model, "permutation": k, "fold": fold, "at": at}
                if counted:
                    right = (score >= 0.5) == (y == 1)
                    out.append(pd.DataFrame(same | {"y": [0, 1], "n": [int((y == c).sum()) for c in (0, 1)], "hits": [int(right[y == c].sum()) for c in (0, 1)]}))
                else:
                    out.append(pd.DataFrame(same | {"place": unseen, "y": y, "score": score}))
        return pd.concat(out)

    return by_unit(columns, chosen, units, fit, HITS if counted else SCORES)


def fitted(picked: pd.DataFrame, x: dict[int, np.ndarray], pair: str, parts: Parts, fit: Fit, role: np.ndarray, model: str, grid: list[dict], seed: int):
    """[(classifier, its columns for all places)] of one fit, for each entry of the grid. Rows drawn more than once weigh more."""
    y, drawn = parts.classes()[role], row_weights(pair, parts, fit, seed)[role]
    rows = np.flatnonzero(drawn)
    picked = picked.sort_values("rank")
    z = np.array([(x[r.feature] - r.mean) / (r.sd or 1.0) for r in picked.itertuples()]).T
    sizes = np.bincount(y, weights=drawn, minlength=2)
    weight = (drawn * (sizes.sum() / (2.0 * np.maximum(sizes, 1)))[y])[rows]
    made = []
    for entry in grid:
        own = z[:, : entry.get("k", 50)]
        made.append((MODELS[model](**entry.get("clf", {})).fit(own[rows], y[rows], weight, np.random.default_rng(0)), own))
    return made


def most(grid: list[dict]) -> int:
    return max(g.get("k", 50) for g in grid)


def nested_cv(features: DataFrame, labels: DataFrame, model: str, grid: list[dict], folds: int = 5, seed: int = 42, key: str = "id", column: str = "x") -> DataFrame:
    """Rows (pair, ml_model, id, y, cv_prob, cv_pred): each row's score by the outer fold that left it out, with the entry of the grid
    that has the best balanced accuracy over the inner folds."""
    steps = Steps(features.sparkSession, "columns")
    columns, places, parts = study(features, labels, folds, key, column)
    columns, places = steps.save(columns), steps.save(places)
    outer = {p: fits_of(q, [0], nested=False) for p, q in parts.items()}
    found = scored(columns, parts, outer, model, grid, seed, steps)
    if len(grid) > 1:
        inner = {p: fits_of(q, [0], nested=True) for p, q in parts.items()}
        best = best_entries(scored(columns, parts, inner, model, grid, seed, steps, counted=True))
        found = found.join(best, ["pair", "ml_model", "fold", "at"], "left_semi")
    named = found.join(places.drop("y"), ["pair", "place"])
    return named.select("pair", "ml_model", "id", "y", F.col("score").alias("cv_prob"), (F.col("score") >= 0.5).cast("int").alias("cv_pred"))


def scored(columns: DataFrame, parts: dict[str, Parts], fits: dict[str, list[Fit]], model: str, grid: list[dict] | dict[str, list[dict]], seed: int, steps: Steps, counted: bool = False) -> DataFrame:
    grids = grid if isinstance(grid, dict) else dict.fromkeys(parts, grid)
    units = units_of(parts, fits, width(columns))
    chosen = steps.save(chosen_features(columns, parts, fits, units, max(map(most, grids.values()), default=1), seed))
    return scores(columns, chosen, parts, fits, units, model, grids, seed, counted)


def width(columns: DataFrame) -> int:
    return (columns.agg(F.max("feature")).first()[0] or 0) + 1


def recalls(hits: DataFrame, *keys: str) -> DataFrame:
    """(*keys, b): balanced accuracy of counted scores."""
    recall = hits.filter("n > 0").groupBy(*keys, "y").agg((F.sum("hits") / F.sum("n")).alias("r"))
    return recall.groupBy(*keys).agg(F.round(F.avg("r"), 12).alias("b"))


def best_entries(hits: DataFrame) -> DataFrame:
    """(pair, ml_model, fold, at): the entry of the best balanced accuracy over the inner folds, the first on ties."""
    order = F.struct("b", (-F.col("at")).alias("neg"))
    return recalls(hits, "pair", "ml_model", "fold", "at").groupBy("pair", "ml_model", "fold").agg(F.max(order).alias("m")).select("pair", "ml_model", "fold", (-F.col("m.neg")).alias("at"))


def accuracy(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Balanced accuracy of (y, score) rows for each of the keys."""
    hit = ((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double")
    recall = predictions.groupBy(*keys, "y").agg(F.avg(hit).alias("r"))
    return recall.groupBy(*keys).agg(F.round(F.avg("r"), 12).alias("balanced_accuracy"))


def best_over_all(columns: DataFrame, parts: dict[str, Parts], model: str, grid: list[dict], seed: int, steps: Steps) -> dict[str, int]:
    """For each pair the place in the grid of its best entry, by cross-validation over all of its rows."""
    if len(grid) == 1:
        return dict.fromkeys(parts, 0)
    inner = {p: fits_of(q, [0], nested=True, outer=False) for p, q in parts.items()}
    return {r["pair"]: r["at"] for r in best_entries(scored(columns, parts, inner, model, grid, seed, steps, counted=True)).collect()}  # a row for each pair


def chosen_entries(features: DataFrame, labels: DataFrame, model: str, grid: list[dict], seed: int = 42, key: str = "id", column: str = "x") -> dict[str, dict]:
    """For each pair the entry of the grid that a final fit should have."""
    steps = Steps(features.sparkSession, "columns")
    columns, _, parts = study(features, labels, 5, key, column)
    return {p: grid[at] for p, at in best_over_all(steps.save(columns), parts, model, grid, seed, steps).items()}


def permutation_test(features: DataFrame, labels: DataFrame, model: str, grid: list[dict], n: int = 200, folds: int = 5, seed: int = 42, key: str = "id", column: str = "x") -> DataFrame:
    """Rows (pair, balanced_accuracy, permuted_mean, permuted_sd, p): the nested cross-validated accuracy, and p = (hits + 1) / (n + 1)
    among cross-validations with shuffled parts, all with the one entry of the grid that is best over all of a pair's rows."""
    steps = Steps(features.sparkSession, "columns")
    columns, _, parts = study(features, labels, folds, key, column)
    columns = steps.save(columns)
    cv = nested_cv(features, labels, model, grid, folds, seed, key, column).withColumnRenamed("cv_prob", "score")
    observed = accuracy(cv, ["pair"])
    frozen = {p: [grid[at]] for p, at in best_over_all(columns, parts, model, grid, seed, steps).items()}
    shuffled = scored(columns, parts, {p: fits_of(q, list(range(1, n + 1)), nested=False) for p, q in parts.items()}, model, frozen, seed, steps, counted=True)
    under = recalls(shuffled, "pair", "permutation")
    hits = under.join(observed, "pair").groupBy("pair", "balanced_accuracy").agg(F.sum((F.col("b") >= F.col("balanced_accuracy") - 1e-12).cast("long")).alias("hits"), F.count(F.lit(1)).alias("n"), F.avg("b").alias("permuted_mean"), F.stddev_samp("b").alias("permuted_sd"))
    return hits.select("pair", "balanced_accuracy", "permuted_mean", "permuted_sd", ((F.col("hits") + 1) / (F.col("n") + 1)).alias("p"))


def importances(features: DataFrame, labels: DataFrame, model: str, k: int = 50, seed: int = 42, key: str = "id", column: str = "x") -> DataFrame:
    """Rows (pair, ml_model, feature_idx, weight, selected): the bags' mean absolute weights in ensembles over all rows of a pair, 0
    where a bag did not choose the feature, and whether any did."""
    steps = Steps(features.sparkSession, "columns")
    columns, _, parts = study(features, labels, 5, key, column)
    columns = steps.save(columns)
    fits = {p: fits_of(q, [0], nested=False, outer=False) for p, q in parts.items()}
    units = {p: np.arange(len(own)) // 4 for p, own in fits.items()}
    chosen = steps.save(chosen_features(columns, parts, fits, units, k, seed))

    def weigh(picked: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        pair, x, out = picked["pair"].iloc[0], dict(zip(frame["of_feature"], frame["x"], strict=True)), []
        for number, own in picked.groupby("fit"):
            fit = fits[pair][number]
            ((made, _),) = fitted(own, x, pair, parts[pair], fit, played(parts[pair], fit[0], seed), model, [{"k": k}], seed)
            out.append(pd.DataFrame({"pair": pair, "ml_model": model, "feature_idx": own.sort_values("rank")["feature"].to_numpy(), "weight": made.importance() / len(fits[pair])}))
        return pd.concat(out)

    used = by_unit(columns, chosen, units, weigh, "pair string, ml_model string, feature_idx int, weight double")
    used = used.groupBy("pair", "ml_model", "feature_idx").agg(F.round(F.sum("weight"), 12).alias("weight"))
    features_of = columns.select(F.col("feature").alias("feature_idx")).distinct()
    names = features.sparkSession.createDataFrame([(p, model) for p in parts] or [("", "")], "pair string, ml_model string").filter("pair <> ''")
    every = features_of.crossJoin(F.broadcast(names))  # a row for each feature and pair is the result
    out = every.join(used, ["pair", "ml_model", "feature_idx"], "left")
    return out.select("pair", "ml_model", F.col("feature_idx").cast("long").alias("feature_idx"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("weight").isNotNull().alias("selected"))
