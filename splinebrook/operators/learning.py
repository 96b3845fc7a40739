"""Pairwise classification of subjects: pipelines, nested cross-validation, permutation tests, importances.

Group studies have few subjects and very many fits (pairs x models x folds x parameters x bags x permutations), so a fit is
a small numpy computation and the fits are rows dealt over the cluster. A row names its pair, model, fold, parameters and bag
(or its permutation); ensembles are averages over bags, accuracies and the choice of parameters are aggregations of the
scores. The subjects' features and labels travel once as a broadcast of checked size, or, in tables_cv, as columns of tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rsa import seed_of
from .scratch import Steps

#: Bytes of features that are broadcast at most; a larger study has to select features first.
MOST_BYTES = 1 << 28
#: Samples whose trees are grown together, and bags of one unit of work.
SAMPLES, BAGS_TOGETHER = 1 << 19, 3
#: Features that are turned into columns together.
COLUMNS = 64


# --- estimators: fit(x, y, weights, rng) -> self, score(x) in 0..1, importance() over their inputs ---------------------


@dataclass
class Logistic:
    """L2 logistic regression by Newton's method; c is the inverse strength, the intercept is free."""

    c: float = 1.0

    def fit(self, x, y, w, rng):
        z = np.hstack([x, np.ones((len(x), 1))])
        penalty = np.full(z.shape[1], 1 / self.c)
        penalty[-1] = 1e-8
        self.b = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.b, -30, 30)))
            g = z.T @ (w * (p - y)) + penalty * self.b
            h = z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(penalty)
            step = np.linalg.solve(h, g)
            step /= max(1.0, np.abs(step).max() / 5)
            self.b -= step
            if np.abs(step).max() < 1e-8:
                break
        return self

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(x @ self.b[:-1] + self.b[-1], -30, 30)))

    def importance(self):
        return np.abs(self.b[:-1])


@dataclass
class LinearSvm:
    """Squared hinge loss by Newton's method; scores by a sigmoid of the margin."""

    c: float = 1.0

    def fit(self, x, y, w, rng):
        z, t = np.hstack([x, np.ones((len(x), 1))]), 2 * y - 1
        self.b = np.zeros(z.shape[1])
        ridge = np.r_[np.ones(x.shape[1]), 1e-8]
        for _ in range(50):
            inside = t * (z @ self.b) < 1
            zi, wi = z[inside], w[inside]
            new = np.linalg.solve(np.diag(ridge) + 2 * self.c * zi.T @ (zi * wi[:, None]), 2 * self.c * zi.T @ (wi * t[inside]))
            if np.abs(new - self.b).max() < 1e-8:
                self.b = new
                break
            self.b = new
        return self

    def score(self, x):
        return 1 / (1 + np.exp(-2 * np.clip(x @ self.b[:-1] + self.b[-1], -15, 15)))

    def importance(self):
        return np.abs(self.b[:-1])


def in_order(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """The stable order by keys of so many values, the least significant first, digit by digit of 16 bits."""
    order = None
    for key, values in keys:
        for shift in range(0, max(int(values - 1).bit_length(), 1), 16):
            digit = ((key >> shift) & 0xFFFF).astype(np.uint16)
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return order


def distinct_samples(x, y, w, rows):
    """(rows of x, trees, times) of the samples. With weights of 1, equal rows of a tree's sample are one that counts several times:
    all sums are whole numbers then, and the same."""
    trees, n = rows.shape
    if not (w == 1).all():
        return rows.ravel(), np.repeat(np.arange(trees), n), np.ones(trees * n, dtype=np.int64)
    _, first, same = np.unique(np.column_stack([x, y]), axis=0, return_index=True, return_inverse=True)
    times = np.stack([np.bincount(same.ravel()[r], minlength=len(first)) for r in rows])
    tree, at = np.nonzero(times)
    return first[at], tree, times[tree, at]


def grow(x, y, w, rows, depth, leaf, features, rng):
    """Classification trees by weighted Gini impurity, all of them a level at a time, and SAMPLES of them together.

    rows: for each tree its sample, as row numbers of x; features None looks at all columns, else at that many random ones
    of each node. Returns the nodes (column or -1, cut, first child, mean of y) and the trees' gains by column.
    """
    trees = len(rows)
    d = x.shape[1]
    row, node, times = distinct_samples(x, y, w, rows)  # of each sample that is not in a leaf yet; nodes of this level
    tree_of, gains = np.arange(trees), np.zeros((trees, d))
    codes = np.stack([np.unique(x[:, c], return_inverse=True)[1] for c in range(d)], axis=1)
    levels, first = [], 0
    for level in range(depth + 1):
        count = len(tree_of)
        weight = times * w[row]
        size = np.bincount(node, times, count)
        total = np.bincount(node, weight, count)
        positive = np.bincount(node, weight * y[row], count)
        column, cut, child, best = np.full(count, -1), np.zeros(count), np.zeros(count, dtype=int), np.full(count, 1e-12)
        open_ = (size >= 2 * leaf) & (positive > 0) & (positive < total) & (level < depth)
        inside = open_[node]
        row, node, times, weight = row[inside], node[inside], times[inside], weight[inside]
        looks = np.tile(np.arange(d), (count, 1)) if features is None else rng.random((count, d)).argsort(axis=1)[:, :features]
        # samples and nodes lie in the order of trees
        together = max(1, trees * SAMPLES // max(len(row), 1))
        edges = np.searchsorted(tree_of[node], np.arange(0, trees + together, together))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            base = node[lo:hi].min()
            here = node[lo:hi] - base
            held = np.bincount(here)
            begin = np.cumsum(held) - held  # where each node's samples begin, in their order
            for slot in range(looks.shape[1]):
                at_column = looks[node[lo:hi], slot]
                code = codes[row[lo:hi], at_column]
                order = in_order((code, len(x)), (here, len(held)))
                g, code = here[order], code[order]
                at = np.flatnonzero((g[1:] == g[:-1]) & (code[1:] > code[:-1]))
                k, before = g[at], begin[g[at]] - 1
                order += lo
                left, wl, pl = (np.cumsum(v) for v in (times[order], weight[order], weight[order] * y[row[order]]))
                left, l, p = (v[at] - np.where(before >= 0, v[before], 0) for v in (left, wl, pl))
                enough = (left >= leaf) & (size[k + base] - left >= leaf)
                at, k, l, p = at[enough], k[enough], l[enough], p[enough]
                if not len(at):
                    continue
                t, q = total[k + base], positive[k + base]
                gain = 2 * (q - q * q / t) - 2 * (p - p * p / l) - 2 * ((q - p) - (q - p) ** 2 / (t - l))
                # each node's best cut, the lowest on ties
                new = np.append(True, k[1:] != k[:-1])
                most = np.maximum.reduceat(gain, np.flatnonzero(new))
                run = np.cumsum(new) - 1
                top = np.flatnonzero(gain == most[run])
                top = top[np.append(True, run[top[1:]] != run[top[:-1]])]
                top = top[gain[top] > best[k[top] + base]]
                to, i = k[top] + base, at[top]
                r, c = row[order[i]], looks[to, slot]
                best[to], column[to], cut[to] = gain[top], c, (x[r, c] + x[row[order[i + 1]], c]) / 2
        split = np.flatnonzero(column >= 0)
        np.add.at(gains, (tree_of[split], column[split]), best[split])
        child[split] = first + count + 2 * np.arange(len(split))
        levels.append((column, cut, child, positive / total))
        if not len(split):
            break
        going = column[node] >= 0
        row, node, times = row[going], node[going], times[going]
        right = x[row, column[node]] > cut[node]
        tree_of = np.repeat(tree_of[split], 2)
        node = child[node] - first - count + right
        first += count
    return tuple(np.concatenate(v) for v in zip(*levels, strict=True)), gains


def fall(nodes, trees: int, x):
    """Mean of the leaves that each row of x reaches in each tree (trees x rows)."""
    column, cut, child, mean = nodes
    at = np.repeat(np.arange(trees)[:, None], len(x), axis=1)
    while (inner := column[at] >= 0).any():
        t, r = np.nonzero(inner)
        k = at[t, r]
        at[t, r] = child[k] + (x[r, column[k]] > cut[k])
    return mean[at]


@dataclass
class Tree:
    """One classification tree that looks at all columns."""

    depth: int = 4
    leaf: int = 5

    def fit(self, x, y, w, rng):
        self.nodes, self.gains = grow(x, y, w, np.arange(len(x))[None, :], self.depth, self.leaf, None, rng)
        return self

    def score(self, x):
        return fall(self.nodes, 1, x)[0]

    def importance(self):
        return self.gains[0] / (self.gains[0].sum() or 1.0)


@dataclass
class Forest:
    """Trees on bootstraps, each node looking at the root of the number of columns."""

    trees: int = 100
    leaf: int = 2
    depth: int = 12

    def fit(self, x, y, w, rng):
        rows = rng.integers(0, len(x), (self.trees, len(x)))
        self.nodes, self.gains = grow(x, y, w, rows, self.depth, self.leaf, max(1, int(np.sqrt(x.shape[1]))), rng)
        return self

    def score(self, x):
        return fall(self.nodes, self.trees, x).mean(axis=0)

    def importance(self):
        totals = self.gains.sum(axis=1, keepdims=True)
        return np.divide(self.gains, totals, out=np.zeros_like(self.gains), where=totals > 0).mean(axis=0)


@dataclass
class Network:
    """Linear, batch normalisation, ReLU, dropout, a latent layer and a logit; Adam, stopped when the loss stalls."""

    hidden: int = 64
    latent: int = 8
    dropout: float = 0.2
    rate: float = 0.01
    epochs: int = 200
    patience: int = 15

    def fit(self, x, y, w, rng):
        d = x.shape[1]
        sizes = ((d, self.hidden), (self.hidden, self.latent), (self.latent, 1))
        p = [a for n, m in sizes for a in (rng.standard_normal((n, m)) * np.sqrt(2 / n), np.zeros(m))]
        p += [np.ones(self.hidden), np.zeros(self.hidden)]
        first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        best, since, w = np.inf, 0, w / w.sum()
        for step in range(1, self.epochs + 1):
            a = x @ p[0] + p[1]
            mean, var = a.mean(axis=0), a.var(axis=0) + 1e-5
            n = (a - mean) / np.sqrt(var)
            b = n * p[6] + p[7]
            drop = (rng.random(b.shape) >= self.dropout) / (1 - self.dropout)
            h = np.maximum(b, 0) * drop
            z = np.maximum(h @ p[2] + p[3], 0)
            out = (z @ p[4] + p[5])[:, 0]
            s = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            loss = -(w * (y * np.log(s + 1e-12) + (1 - y) * np.log(1 - s + 1e-12))).sum()
            go = (w * (s - y))[:, None]
            gz = (go @ p[4].T) * (z > 0)
            gb = (gz @ p[2].T) * drop * (b > 0)
            gn = gb * p[6]
            ga = (gn - gn.mean(axis=0) - n * (gn * n).mean(axis=0)) / np.sqrt(var)
            grads = [x.T @ ga, ga.sum(axis=0), h.T @ gz, gz.sum(axis=0), z.T @ go, go.sum(axis=0), (gb * n).sum(axis=0), gb.sum(axis=0)]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - self.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            self.mean, self.var = mean, var
            if loss < best - 1e-4:
                best, since = loss, 0
            else:
                since += 1
                if since >= self.patience:
                    break
        self.p, self.x = p, x
        return self

    def hidden_of(self, x):
        return np.maximum((x @ self.p[0] + self.p[1] - self.mean) / np.sqrt(self.var) * self.p[6] + self.p[7], 0)

    def transform_latent(self, x):
        return np.maximum(self.hidden_of(x) @ self.p[2] + self.p[3], 0)

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip((self.transform_latent(x) @ self.p[4] + self.p[5])[:, 0], -30, 30)))

    def importance(self):
        """Mean absolute gradient of the logit over the training rows."""
        h = self.hidden_of(self.x)
        z = h @ self.p[2] + self.p[3]
        g = ((z > 0) * self.p[4][:, 0]) @ self.p[2].T * (h > 0) * self.p[6] / np.sqrt(self.var)
        return np.abs(g @ self.p[0].T).mean(axis=0)


# --- pipelines -----------------------------------------------------------------------------------------------------------


def anova_top(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k features with the largest one-way F statistic; the first on ties."""
    a, b = x[y == 0], x[y == 1]
    grand = x.mean(axis=0)
    between = len(a) * (a.mean(axis=0) - grand) ** 2 + len(b) * (b.mean(axis=0) - grand) ** 2
    within = ((a - a.mean(axis=0)) ** 2).sum(axis=0) + ((b - b.mean(axis=0)) ** 2).sum(axis=0)
    f = np.divide(between * (len(x) - 2), within, out=np.where(between > 0, np.inf, 0.0), where=within > 0)
    return np.sort(np.argsort(-f, kind="stable")[: min(k, x.shape[1])])


def forest_select(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng) -> np.ndarray:
    """Features of at least mean importance in a forest of 100 trees."""
    v = Forest(100).fit(x, y, w, rng).importance()
    keep = np.flatnonzero(v >= v.mean())
    return keep if len(keep) else np.arange(x.shape[1])


@dataclass
class Pipeline:
    """Scale by the population deviation, select features, then classify with balanced weights."""

    make: Callable[..., object]
    select: str = "anova"
    params: dict = field(default_factory=dict)
    k: int = 50

    def fit(self, x, y, rng):
        self.mean, sd = x.mean(axis=0), x.std(axis=0)
        self.sd = np.where(sd > 0, sd, 1.0)
        z = (x - self.mean) / self.sd
        counts = np.bincount(y, minlength=2)
        w = len(y) / (2.0 * np.maximum(counts, 1))[y]
        self.kept = {"anova": lambda: anova_top(z, y, self.k), "forest": lambda: forest_select(z, y, w, rng), "none": lambda: np.arange(x.shape[1])}[self.select]()
        self.model = self.make(**self.params).fit(z[:, self.kept], y, w, rng)
        self.size = x.shape[1]
        return self

    def score(self, x):
        return self.model.score(((x - self.mean) / self.sd)[:, self.kept])

    def importance(self):
        """(importance, selected) over all features."""
        out, selected = np.zeros(self.size), np.zeros(self.size, dtype=bool)
        out[self.kept], selected[self.kept] = self.model.importance(), True
        return out, selected


MODELS: dict[str, Callable[[dict], Pipeline]] = {
    "LR": lambda p: Pipeline(Logistic, "anova", p.get("clf", {}), p.get("k", 50)),
    "SVM": lambda p: Pipeline(LinearSvm, "anova", p.get("clf", {}), p.get("k", 50)),
    "DTree": lambda p: Pipeline(Tree, "forest", p.get("clf", {})),
    "RandForest": lambda p: Pipeline(Forest, "forest", {"trees": 300} | p.get("clf", {})),
    "NN": lambda p: Pipeline(Network, "none", p.get("clf", {})),
}


def parameter_grid(spec: dict | str) -> list[dict]:
    """All combinations of a JSON object of lists; "k" is for the selector, the rest for the classifier."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    names = sorted(spec)
    return [{"k": c["k"], "clf": {n: v for n, v in c.items() if n != "k"}} if "k" in c else {"clf": c} for c in (dict(zip(names, v, strict=True)) for v in product(*(spec[n] for n in names)))] or [{}]


def bags(model: str, y: np.ndarray) -> int:
    """Bags of an ensemble: 0 (one plain pipeline) unless there are 20 subjects and 7 of the smaller class."""
    if len(y) >= 20 and np.bincount(y, minlength=2).min() >= 7:
        return 5 if model in ("RandForest", "NN") else 30
    return 0


def fit_bag(model: str, params: dict, x: np.ndarray, y: np.ndarray, bagged: bool, rng) -> Pipeline:
    """One member: a pipeline on a bootstrap with the majority class under-sampled, or on all rows."""
    if bagged:
        least = np.bincount(y, minlength=2).min()
        rows = np.concatenate([rng.choice(np.flatnonzero(y == c), least, replace=True) for c in (0, 1)])
        x, y = x[rows], y[rows]
    return MODELS[model](params).fit(x, y, rng)


def mean_score(model: str, params: dict, x: np.ndarray, y: np.ndarray, unseen: np.ndarray, rng) -> np.ndarray:
    """Scores of a whole ensemble in one task, for permutations, which are rows themselves."""
    n = bags(model, y)
    return np.mean([fit_bag(model, params, x, y, n > 0, rng).score(unseen) for _ in range(max(n, 1))], axis=0)


def folds(y: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Stratified fold of each row; every row its own fold where the smaller class is smaller than k."""
    if np.bincount(y, minlength=2).min() < k:
        return np.arange(len(y))
    out, rng = np.empty(len(y), dtype=int), np.random.default_rng(seed)
    for c in (0, 1):
        rows = rng.permutation(np.flatnonzero(y == c))
        out[rows] = np.arange(len(rows)) % k
    return out


def balanced_accuracy(y: np.ndarray, score: np.ndarray) -> float:
    h = score >= 0.5
    return float(np.mean([np.mean(h[y == c] == c) for c in (0, 1) if (y == c).any()]))


def auc(y: np.ndarray, score: np.ndarray) -> float:
    a, b = score[y == 1], score[y == 0]
    if not len(a) or not len(b):
        return float("nan")
    return float(((a[:, None] > b[None, :]).mean() + (a[:, None] == b[None, :]).mean() / 2))


# --- on the cluster --------------------------------------------------------------------------------------------------------


def study(features: DataFrame, id_col: str, x_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and features in the order of ids; refuses what is too large to broadcast."""
    size = features.agg(F.sum(F.size(x_col) * 8)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of features; select features before the study")
    rows = features.select(id_col, x_col).orderBy(id_col).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)


TASK = "pair string, ml_model string, fold int, at int, inner int, bags int"


def fold_tasks(pairs: dict[str, np.ndarray], models: list[str], grids: dict[str, list[dict]], k: int, seed: int, outer: bool = True, nested: bool = False) -> list[tuple]:
    """Fits to be made, one for each ensemble: the outer folds' (inner = -1), or for each of them the inner folds' with
    every set of parameters of models that have several. Without outer folds, fold = -1 holds nothing out."""
    out = []
    for p, labels in pairs.items():
        y = labels[labels >= 0]
        at = folds(y, k, seed) if outer else np.zeros(len(y), dtype=int)
        for f in np.unique(at) if outer else [-1]:
            left = y[at != f]
            inner = folds(left, 3)
            for m in models:
                if not nested:
                    out.append((p, m, int(f), -1, -1, bags(m, left)))
                elif len(grids[m]) > 1:
                    out += [(p, m, int(f), g, int(i), bags(m, left[inner != i])) for g in range(len(grids[m])) for i in np.unique(inner)]
    return out


def fold_scores(spark: SparkSession, data, tasks: DataFrame, fits: int, k: int, seed: int) -> DataFrame:
    """tasks (TASK) -> (pair, ml_model, fold, at, row, y, score): what each ensemble says of the rows it has not seen."""
    single = tasks.withColumn("bag", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bags"), F.lit(1)) - 1)))

    def run(batches):
        held, labels, grids = data.value
        for pdf in batches:
            for t in pdf.itertuples():
                rows = np.flatnonzero(labels[t.pair] >= 0)
                y = labels[t.pair][rows]
                if t.fold >= 0:
                    test = folds(y, k, seed) == t.fold
                if t.inner >= 0:
                    if t.fold >= 0:
                        rows, y = rows[~test], y[~test]
                    test = folds(y, 3) == t.inner
                rng = np.random.default_rng(seed_of(t.pair, t.ml_model, t.fold, t.at, t.inner, t.bag, seed))
                fitted = fit_bag(t.ml_model, grids[t.ml_model][max(t.at, 0)], held[rows[~test]], y[~test], t.bags > 0, rng)
                yield pd.DataFrame({"pair": t.pair, "ml_model": t.ml_model, "fold": t.fold, "at": t.at, "row": rows[test], "y": y[test].astype("int32"), "score": fitted.score(held[rows[test]])})

    found = single.repartition(max(1, min(fits, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "pair string, ml_model string, fold int, at int, row long, y int, score double")
    # the order of a sum must not decide a score on the edge
    return found.groupBy("pair", "ml_model", "fold", "at", "row", "y").agg(F.round(F.avg("score"), 12).alias("score"))


def best_at(scores: DataFrame) -> DataFrame:
    """(pair, ml_model, fold, at): the parameters of the best balanced accuracy over the inner folds, the first on ties."""
    hit = ((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double")
    recall = scores.groupBy("pair", "ml_model", "fold", "at", "y").agg(F.avg(hit).alias("r"))
    accuracy = recall.groupBy("pair", "ml_model", "fold", "at").agg(F.round(F.avg("r"), 12).alias("b"))
    return accuracy.groupBy("pair", "ml_model", "fold").agg(F.max(F.struct("b", (-F.col("at")).alias("neg"))).alias("m")).select("pair", "ml_model", "fold", (-F.col("m.neg")).alias("at"))


def nested_cv(spark: SparkSession, x: np.ndarray, ids: np.ndarray, pairs: dict[str, np.ndarray], models: list[str], grids: dict[str, list[dict]] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows (pair, ml_model, id, y, cv_prob, cv_pred): each subject's score from the outer fold that left it out.

    pairs: for each name the labels 0, 1 or -1 (not in the pair) of all subjects. One row of work is one bag of one fold.
    """
    grids = {m: (grids or {}).get(m) or [{}] for m in models}
    data = spark.sparkContext.broadcast((x, pairs, grids))
    outer = fold_tasks(pairs, models, grids, k, seed)
    tasks = spark.createDataFrame(outer, TASK)
    inner = fold_tasks(pairs, models, grids, k, seed, nested=True)
    if inner:
        chosen = best_at(fold_scores(spark, data, spark.createDataFrame(inner, TASK), sum(max(t[-1], 1) for t in inner), k, seed))
        tasks = tasks.drop("at").join(chosen, ["pair", "ml_model", "fold"], "left").select("pair", "ml_model", "fold", F.coalesce("at", F.lit(-1)).alias("at"), "inner", "bags")
    found = fold_scores(spark, data, tasks, sum(max(t[-1], 1) for t in outer), k, seed)
    names = spark.createDataFrame([(int(n), str(v)) for n, v in enumerate(ids)], "row long, id string")
    return found.join(F.broadcast(names), "row").select("pair", "ml_model", "id", "y", F.col("score").alias("cv_prob"), (F.col("score") >= 0.5).cast("int").alias("cv_pred"))


def tables_cv(features: DataFrame, labels: DataFrame, models: list[str], k: int = 5, seed: int = 42, key: str = "id", column: str = "x") -> DataFrame:
    """nested_cv's rows without grids, of features (key, x) and labels (pair, key, y): the same fits on the same rows, but each unit of
    bags gets its pair's columns by a shuffle. A pair needs two rows of each class; there may be 7 folds."""
    if k > 7:
        raise ValueError("more than 7 folds: whether a fit is bagged would depend on the order of rows")
    spark, steps = features.sparkSession, Steps(features.sparkSession, "trees")
    kept = features.select(F.col(key).alias("id"), F.col(column).alias("x"))
    known = labels.filter(F.col("y").isin(0, 1)).select("pair", F.col(key).alias("id"), "y").join(kept.select("id"), "id", "left_semi")
    places = steps.save(known.select("pair", (F.row_number().over(Window.partitionBy("pair").orderBy("id")) - 1).alias("place"), "id", "y"))
    sizes = {r[0]: (int(r[1]), int(r[2])) for r in places.groupBy("pair").agg(F.sum(1 - F.col("y")), F.sum("y")).collect()}  # a row a pair
    # fold sizes, and so the fits, follow from the classes' sizes
    pairs = {p: np.repeat([0, 1], n) for p, n in sorted(sizes.items()) if min(n) > 1}
    work: dict[tuple[str, int], list[tuple]] = {}
    for n, t in enumerate(fold_tasks(pairs, models, {m: [{}] for m in models}, k, seed)):
        for bag in range(max(t[-1], 1)):
            work.setdefault((t[0], n * 1000 + bag // BAGS_TOGETHER), []).append((*t, bag))

    def turn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        x = np.array(frame["v"].tolist()).T
        return pd.DataFrame({"pair": frame["pair"].iloc[0], "feature": int(frame["first"].iloc[0]) + np.arange(len(x)), "x": list(x)})

    cut = F.transform(F.sequence(F.lit(0), F.size("x") - 1, F.lit(COLUMNS)), lambda c: F.struct(c.alias("first"), F.slice("x", c + 1, COLUMNS).alias("v")))
    values = places.join(kept.filter("size(x) > 0"), "id").select("pair", "place", F.explode(cut).alias("c")).select("pair", "place", "c.first", F.col("c.v").cast("array<double>").alias("v"))
    classes = places.select("pair", "place", F.lit(-1).alias("first"), F.array(F.col("y").cast("double")).alias("v"))
    columns = steps.save(values.unionByName(classes).groupBy("pair", "first").applyInPandas(turn, "pair string, feature int, x array<double>"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("feature")
        x = np.stack(frame["x"].to_list(), axis=1)
        y, x, out = x[:, 0].astype(int), np.ascontiguousarray(x[:, 1:]), []
        for pair, model, fold, at, inner, bagged, bag in work[frame["pair"].iloc[0], int(frame["unit"].iloc[0])]:
            test = folds(y, k, seed) == fold
            rng = np.random.default_rng(seed_of(pair, model, fold, at, inner, bag, seed))
            fitted = fit_bag(model, {}, x[~test], y[~test], bagged > 0, rng)
            out.append(pd.DataFrame({"pair": pair, "ml_model": model, "place": np.flatnonzero(test), "score": fitted.score(x[test])}))
        return pd.concat(out)

    units = spark.createDataFrame(list(work) or [("", 0)], "pair string, unit int")
    dealt = columns.join(F.broadcast(units), "pair").repartition(max(1, min(4 * len(work), 2000)), "pair", "unit")
    found = dealt.groupBy("pair", "unit").applyInPandas(run, "pair string, ml_model string, place int, score double")
    means = found.groupBy("pair", "ml_model", "place").agg(F.round(F.avg("score"), 12).alias("score"))
    named = means.join(places, ["pair", "place"])
    return named.select("pair", "ml_model", F.col("id").cast("string").alias("id"), F.col("y").cast("int").alias("y"), F.col("score").alias("cv_prob"), (F.col("score") >= 0.5).cast("int").alias("cv_pred"))


def accuracies(predictions: DataFrame) -> DataFrame:
    """nested_cv's rows -> (pair, ml_model, balanced_accuracy)."""
    recall = predictions.groupBy("pair", "ml_model", "y").agg(F.avg((F.col("cv_pred") == F.col("y")).cast("double")).alias("r"))
    return recall.groupBy("pair", "ml_model").agg(F.avg("r").alias("balanced_accuracy"))


def chosen_params(spark: SparkSession, x: np.ndarray, pairs: dict[str, np.ndarray], model: str, grid: list[dict], seed: int = 42) -> dict[str, dict]:
    """For each pair the best parameters by cross-validation over all of its subjects."""
    if len(grid) == 1:
        return dict.fromkeys(pairs, grid[0])
    tasks = fold_tasks(pairs, [model], {model: grid}, 3, seed, outer=False, nested=True)
    data = spark.sparkContext.broadcast((x, pairs, {model: grid}))
    chosen = best_at(fold_scores(spark, data, spark.createDataFrame(tasks, TASK), sum(max(t[-1], 1) for t in tasks), 3, seed))
    return {r["pair"]: grid[r["at"]] for r in chosen.collect()}  # one row a pair


def permutation_test(spark: SparkSession, x: np.ndarray, y: np.ndarray, model: str, observed: float, n: int = 200, k: int = 5, seed: int = 42, params: dict | None = None) -> float:
    """p of a balanced accuracy: cross-validation with shuffled labels, permutation i seeded by seed + i; failures don't count.

    The estimator is that of nested_cv (bagged where there are subjects enough) with the given parameters.
    """
    data = spark.sparkContext.broadcast((x, y, params or {}))

    def run(batches):
        held, labels, chosen = data.value
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng(seed + int(i))
                shuffled = rng.permutation(labels)
                try:
                    s = np.empty(len(shuffled))
                    at = folds(shuffled, k, seed)
                    for f in np.unique(at):
                        s[at == f] = mean_score(model, chosen, held[at != f], shuffled[at != f], held[at == f], rng)
                    out.append(balanced_accuracy(shuffled, s))
                except np.linalg.LinAlgError:
                    out.append(float("nan"))
            yield pd.DataFrame({"b": out})

    got = spark.range(0, n, 1, min(n, 32)).mapInPandas(run, "b double").filter(~F.isnan("b"))
    r = got.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("b") >= observed - 1e-12).cast("int")).alias("h")).first()
    return ((r["h"] or 0) + 1) / (r["n"] + 1)


def importances(spark: SparkSession, x: np.ndarray, pairs: dict[str, np.ndarray], models: list[str], seed: int = 42) -> DataFrame:
    """Rows (pair, ml_model, feature_idx, weight, selected) of ensembles fitted on all subjects of each pair: the bags' mean
    weights, and whether any bag's selector took the feature."""
    data = spark.sparkContext.broadcast((x, pairs))
    tasks = [(p, m, bags(m, y[y >= 0]), bag) for p, y in pairs.items() for m in models for bag in range(max(bags(m, y[y >= 0]), 1))]
    df = spark.createDataFrame(tasks, "pair string, ml_model string, bags int, bag int").repartition(max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches):
        held, labels = data.value
        for pdf in batches:
            for t in pdf.itertuples():
                rows = np.flatnonzero(labels[t.pair] >= 0)
                fitted = fit_bag(t.ml_model, {}, held[rows], labels[t.pair][rows], t.bags > 0, np.random.default_rng(seed_of(t.pair, t.ml_model, t.bag, seed)))
                weight, selected = fitted.importance()
                yield pd.DataFrame({"pair": t.pair, "ml_model": t.ml_model, "feature_idx": np.arange(len(weight)), "weight": weight, "selected": selected})

    found = df.mapInPandas(run, "pair string, ml_model string, feature_idx long, weight double, selected boolean")
    return found.groupBy("pair", "ml_model", "feature_idx").agg(F.round(F.avg("weight"), 12).alias("weight"), F.bool_or("selected").alias("selected"))


def principal_plane(x: np.ndarray, dims: int = 2) -> np.ndarray:
    """Coordinates on the leading principal axes, each axis' largest loading positive."""
    c = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    v = v[:dims] * np.where(v[np.arange(min(dims, len(v))), np.abs(v[:dims]).argmax(axis=1)] < 0, -1, 1)[:, None]
    return c @ v.T
