"""Relational operators on metadata, region series, importances and reports. Everything here is DataFrame algebra."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import category, pearson


def roi_means(long: DataFrame, rois: DataFrame, value: str = "y") -> DataFrame:
    """Rows (roi, t, value): mean over the voxels of each region, zeros for regions without voxels."""
    means = long.groupBy("roi", "t").agg(F.avg(value).alias("value"))
    grid = F.broadcast(rois).crossJoin(F.broadcast(long.select("t").distinct()))  # regions x volumes
    return grid.join(means, ["roi", "t"], "left").fillna(0.0, ["value"])


def valid_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of different groups, the smaller name first; "mus" only against "NM"."""
    names = groups.select("group").distinct()
    a, b = names.select(F.col("group").alias("group_0")), names.select(F.col("group").alias("group_1"))
    pairs = a.join(F.broadcast(b), F.col("group_0") < F.col("group_1"))
    mus = (F.col("group_0") == "mus") | (F.col("group_1") == "mus")
    nm = (F.col("group_0") == "NM") | (F.col("group_1") == "NM")
    return pairs.filter(~mus | nm)


def valid_targets(df: DataFrame, target: Column, id_col: str, least_groups: int = 2, least_rows: int = 5) -> DataFrame:
    """Rows (id, category) with a known category; none at all if too few rows or categories are left."""
    known = df.select(id_col, category(target).alias("category")).filter(~F.col("category").isin("Unknown/None", "Missing Data"))
    enough = known.agg(F.count_distinct("category").alias("k"), F.count(F.lit(1)).alias("n")).filter((F.col("k") >= least_groups) & (F.col("n") >= least_rows)).select(F.lit(1).alias("enough"))
    return known.join(F.broadcast(enough)).drop("enough")


def concatenated(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row for each key: its movements' series one after the other, in the order of `order` (a key has few of them)."""
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    return series.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p[value])).alias(value))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def deviation(a: Column, n: int) -> Column:
    """Population standard deviation of an array of n values."""
    mean = total(a) / n
    return F.sqrt(total(F.transform(a, lambda x: (x - mean) * (x - mean))) / n)


def window_features(series: DataFrame, keys: list[str], n: int, split: int, windows: int = 6, column: str = "y") -> DataFrame:
    """Rows (*keys, experiment, block, value): for the series before and from `split`, population deviation (block 0), mean
    absolute value (1) and the means of `windows` runs, the first of them longer by one where they don't come out even."""
    rows = []
    for experiment, (lo, hi) in enumerate(((0, split), (split, n)), 1):
        size = hi - lo
        part = F.slice(column, lo + 1, size)
        values = [deviation(part, size), total(F.transform(part, F.abs)) / size]
        at = lo
        for w in range(windows):
            length = size // windows + (w < size % windows)
            values.append(total(F.slice(column, at + 1, length)) / length if length else F.lit(None).cast("double"))
            at += length
        rows += [F.struct(F.lit(experiment).alias("experiment"), F.lit(b).alias("block"), v.alias("value")) for b, v in enumerate(values)]
    return series.select(*keys, F.explode(F.array(*rows)).alias("f")).select(*keys, "f.experiment", "f.block", "f.value")


def event_features(series: DataFrame, keys: list[str], n: int, segments: list[tuple[int, int]], transitions: list[int], delay: int = 6, column: str = "y") -> DataFrame:
    """Rows (*keys, block, value): mean, population deviation, segment means delayed by `delay` (the whole mean if fewer than
    3 values are left), and jumps at transitions (mean of 11 from it less that of 5 before; 0 too near an end)."""
    whole = F.col(column)
    mean = total(whole) / n
    values = [mean, deviation(whole, n)]
    for start, end in segments:
        lo, hi = min(start + delay, n), min(end + delay, n)
        values.append(total(F.slice(column, lo + 1, hi - lo)) / (hi - lo) if hi - lo >= 3 else mean)
    for tr in transitions:
        if 5 <= tr < n - 5:
            hi = min(tr + 11, n)
            values.append(total(F.slice(column, tr + 1, hi - tr)) / (hi - tr) - total(F.slice(column, tr - 4, 5)) / 5)
        else:
            values.append(F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(b).alias("block"), v.alias("value")) for b, v in enumerate(values)])
    return series.select(*keys, F.explode(rows).alias("f")).select(*keys, "f.block", "f.value")


def connectivity(series: DataFrame, subject: str, rois: list[str], column: str = "y") -> DataFrame:
    """Rows (subject, roi_i, roi_j, r, present): the upper triangle of each subject's region correlations, from one row a
    subject; present: the subject has both regions."""
    wide = series.groupBy(subject).agg(F.map_from_entries(F.collect_list(F.struct("roi", column))).alias("m"))
    pairs = [F.struct(F.lit(a).alias("roi_i"), F.lit(b).alias("roi_j"), pearson(F.col("m")[a], F.col("m")[b]).alias("r"), (F.map_contains_key("m", F.lit(a)) & F.map_contains_key("m", F.lit(b))).alias("present")) for a, b in combinations(rois, 2)]
    return wide.select(subject, F.explode(F.array(*pairs)).alias("p")).select(subject, "p.roi_i", "p.roi_j", "p.r", "p.present")


def feature_layout(n_features: int, n_roi: int, kind: str = "flat", split: int = 0, blocks: int = 8) -> list[tuple[int, int, int, int]]:
    """(feature, roi, experiment, block or volume). flat: roi + volume * n_roi; blocks: experiment, then block, then roi."""
    out = []
    for k in range(n_features):
        if kind == "flat":
            t = k // n_roi
            out.append((k, k % n_roi, 1 if t < split else 2, t if t < split else t - split))
        else:
            out.append((k, k % n_roi, k // (blocks * n_roi) + 1, k // n_roi % blocks))
    return out


def layout_columns(feature: Column, n_roi: int, split: int = 0, kind: str = "flat", blocks: int = 8) -> list[Column]:
    """roi, experiment, and volume or block of a feature's number, as feature_layout has them."""
    if kind == "flat":
        t = F.floor(feature / n_roi)
        return [(feature % n_roi).alias("roi"), F.when(t < split, 1).otherwise(2).alias("experiment"), F.when(t < split, t).otherwise(t - split).alias("block")]
    return [(feature % n_roi).alias("roi"), (F.floor(feature / (blocks * n_roi)) + 1).alias("experiment"), (F.floor(feature / n_roi) % blocks).alias("block")]


def infer_layout(n_features: int, n_roi: int, n_volumes: int, blocks: int = 8, experiments: int = 2) -> str:
    """Which layout a vector of so many features has: "flat" volumes, or "blocks" of each experiment; an error if neither."""
    kinds = {"flat": n_roi * n_volumes, "blocks": n_roi * blocks * experiments}
    fits = [kind for kind, n in kinds.items() if n == n_features]
    if len(fits) != 1:
        raise ValueError(f"{n_features} features fit {fits or 'no'} layout of {n_roi} regions")
    return fits[0]


def flattened(series: DataFrame, keys: list[str], rois: list[str], n: int, column: str = "y") -> DataFrame:
    """Rows (*keys, x array<double>): volumes one after another, within a volume the regions in the given order."""
    wide = series.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("roi", column))).alias("m"))
    parts = [F.coalesce(F.col("m")[r], F.array_repeat(F.lit(0.0), n)) for r in rois]
    return wide.select(*keys, F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda t: F.array(*[F.element_at(p, t) for p in parts]))).alias("x"))


def min_max(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Scaled to 0..1 within the keys; unchanged where all values are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.col(value)))


def ranked(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Adds rank, 1 for the largest value in the keys; ties go to the greater name."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.desc(tie))))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def consensus(imp: DataFrame, least_models: int = 4) -> DataFrame:
    """Rows (pair, n_rois): regions that so many models share in a pair's top rows; pairs without any count 0."""
    shared = imp.groupBy("pair", "roi").agg(F.count_distinct("ml_model").alias("k")).filter(F.col("k") >= least_models)
    counts = shared.groupBy("pair").agg(F.count(F.lit(1)).alias("n_rois"))
    return imp.select("pair").distinct().join(counts, "pair", "left").fillna(0, ["n_rois"])


def bh_fdr(df: DataFrame, p: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Adds q, the Benjamini-Hochberg values within the keys: p n / rank, made monotone from above, at most 1."""
    keys = keys or []
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    up = by.orderBy(p, *order)
    raw = df.withColumn("_raw", F.col(p) * F.count(F.lit(1)).over(by) / F.row_number().over(up))
    down = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return raw.withColumn("q", F.least(F.min("_raw").over(down), F.lit(1.0))).drop("_raw")


def running_below(values: DataFrame, by: str, amount: str, pieces: int = 64) -> DataFrame:
    """values, one row for each value of by -> with below, the sum of amount over all smaller ones.

    The values are cut at approximate quantiles; each piece has a window of its own, and what lies below a piece is a sum of
    at most `pieces` numbers, so no task sees all rows.
    """
    cuts = sorted(set(values.approxQuantile(by, [k / pieces for k in range(1, pieces)], 0.25 / pieces)))
    piece = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(by))) if cuts else F.lit(0)
    placed = values.withColumn("_piece", piece)
    totals = {r["_piece"]: r["t"] for r in placed.groupBy("_piece").agg(F.sum(amount).alias("t")).collect()}
    lower = F.array(*[F.lit(sum(t for k, t in totals.items() if k < p)) for p in range(len(cuts) + 1)])
    within = F.sum(amount).over(Window.partitionBy("_piece").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("below", F.element_at(lower, F.col("_piece") + 1) + F.coalesce(within, F.lit(0))).drop("_piece")


def mid_ranks(df: DataFrame, value: str, keys: list[str], out: str = "mid_rank") -> DataFrame:
    """Ranks with ties at their mean; without keys over all rows, by way of the distinct values."""
    if not keys:
        counts = running_below(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), value, "_n")
        return df.join(counts.select(value, (F.col("below") + (F.col("_n") + 1) / 2.0).alias(out)), value)
    w = Window.partitionBy(*keys)
    first = F.rank().over(w.orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(out, first + (ties - 1) / 2.0)


def run_starts(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Adds run, the number of the run of equal labels in order."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = by.orderBy(*order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def symmetric_lookup(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """pairs (group_0, group_1, ...) with distance, intra_0 and intra_1 of (group_a, group_b, distance, intra_a, intra_b) in
    either order."""
    straight = distances.select(F.col("group_a").alias("group_0"), F.col("group_b").alias("group_1"), "distance", F.col("intra_a").alias("intra_0"), F.col("intra_b").alias("intra_1"))
    turned = distances.select(F.col("group_b").alias("group_0"), F.col("group_a").alias("group_1"), "distance", F.col("intra_b").alias("intra_0"), F.col("intra_a").alias("intra_1"))
    return pairs.join(straight.unionByName(turned).dropDuplicates(["group_0", "group_1"]), ["group_0", "group_1"], "left")


def intra_lookup(pairs: DataFrame, intra: DataFrame) -> DataFrame:
    """Adds intra_a and intra_b from intra (group, value)."""
    a, b = intra.select(F.col("group").alias("group_a"), F.col("value").alias("intra_a")), intra.select(F.col("group").alias("group_b"), F.col("value").alias("intra_b"))
    return pairs.join(a, "group_a", "left").join(b, "group_b", "left")


def classification_metrics(df: DataFrame, y: str, predicted: str, score: str) -> DataFrame:
    """One row: n, tn, fp, fn, tp, accuracy, balanced_accuracy, auc (by mid-ranks of the score's distinct values)."""
    hit = lambda a, b: F.sum(F.when((F.col(y) == a) & (F.col(predicted) == b), 1).otherwise(0)).cast("long")
    counts = df.agg(F.count(F.lit(1)).alias("n"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))
    values = df.groupBy(score).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("neg"))
    auc = running_below(values, score, "neg").withColumn("w", F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).agg((F.sum("w") / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return counts.crossJoin(auc).withColumn("accuracy", (F.col("tn") + F.col("tp")) / F.col("n")).withColumn("balanced_accuracy", (F.col("tp") / (F.col("tp") + F.col("fn")) + F.col("tn") / (F.col("tn") + F.col("fp"))) / 2)


def anova_f(long: DataFrame, feature: str = "feature", label: str = "label", value: str = "value") -> DataFrame:
    """Rows (feature, f_stat): the one-way F statistic over the label's groups, from counts, sums and squares."""
    g = long.groupBy(feature, label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.groupBy(feature).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("square"))
    between = F.col("square") - F.col("total") * F.col("mean") * F.col("mean")
    return s.select(feature, ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("total") - F.col("k")))).alias("f_stat"))


def standardised(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Adds z: less the feature's mean, by its population deviation (0 where that is 0)."""
    s = long.groupBy(feature).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))
    return long.join(F.broadcast(s), feature).withColumn("z", F.when(F.col("sd") > 0, (F.col(value) - F.col("m")) / F.col("sd")).otherwise(0.0)).drop("m", "sd")


def roi_scores(weights: DataFrame, layout: DataFrame, how: str = "mean_abs") -> DataFrame:
    """Rows (roi, score): mean or sum of the absolute weights of a region's selected features, 0 without any."""
    agg = F.avg if how == "mean_abs" else F.sum
    found = layout.join(weights.filter("selected"), "feature_idx").groupBy("roi").agg(agg(F.abs("weight")).alias("score"))
    return layout.select("roi").distinct().join(found, "roi", "left").fillna(0.0, ["score"])


def newest(files: DataFrame, keys: list[str], time: str = "modified") -> DataFrame:
    """One row for each key: the newest file, the greater path on ties."""
    return files.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(time, "path")).alias("m")).select("m.*")
