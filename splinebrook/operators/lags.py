"""Joint search for the lags and durations of several stimuli, for all groups of series at once.

A group (a component in a movement, say) has several series over one time axis and a list of stimulus times. A regressor is the
union of one boxcar for each stimulus, from its time plus a lag and as long as a duration; its value is the mean absolute
correlation with the group's series. Each stimulus's lag is first chosen alone, with a duration of 1, then its duration with
that lag; then all lags and durations climb together: the moves of one stimulus by a step (lag up, lag down, longer, shorter)
are gone through in order, the first that is better is taken, and the search goes on behind it until a whole round has none.

Every round works out the moves of all groups in one aggregation: candidates are rows that meet their group's series in a join,
and a series gives a correlation from its prefix sums, one difference for each run of covered samples. States are a row for
each group and stay on the cluster.

Series without spread have no correlation and do not count; a candidate that covers no sample or all has none, and is never
taken. Of values that agree to DIGITS digits the first candidate wins. Groups without stimuli, or null keys, give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fpca import as_lists, map_series
from .scratch import Steps

DIGITS = 9
#: A move counts as better from here on; below it is the noise of sums in another order.
BETTER = 10.0**-DIGITS
#: Changes of (lag, duration) in the order in which moves are tried, in steps.
MOVES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def prefix_sums(series: DataFrame, column: str = "y") -> DataFrame:
    """`sums` in place of the series: sums of the first 0, 1, ... samples of the centred series of length 1; empty without spread."""

    def step(x):
        centred = x - x.mean(axis=1, keepdims=True)
        length = np.sqrt((centred * centred).sum(axis=1, keepdims=True))
        flat = length[:, 0] <= 1e-12 * np.maximum(1.0, np.abs(x).max(axis=1, initial=0.0))
        sums = np.cumsum(np.divide(centred, length, out=np.zeros_like(centred), where=length > 0), axis=1)
        found = np.concatenate([np.zeros((len(x), 1)), sums], axis=1)
        found[flat] = np.nan
        return (as_lists(found),)

    return map_series(series, column, "sums array<double>", step).filter(~F.isnan(F.element_at("sums", 1)))


def covered(times: Column, start: Column, end: Column) -> Column:
    """The run of samples from start to end, both included: its first and the one behind its last."""
    return F.struct(F.size(F.filter(times, lambda t: t < start)).alias("first"), F.size(F.filter(times, lambda t: t <= end)).alias("stop"))


def correlation(sums: Column, runs: Column) -> Column:
    """Absolute correlation of a series, given by its prefix sums, with the union of runs of samples; null where it has none."""
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def add(so_far, run):
        first = F.greatest(run["first"], so_far["reach"])
        stop = F.greatest(run["stop"], first)
        inside = F.element_at(sums, stop + 1) - F.element_at(sums, first + 1)
        return F.struct((so_far["sum"] + inside).alias("sum"), (so_far["n"] + stop - first).alias("n"), F.greatest(so_far["reach"], stop).alias("reach"))

    found = F.aggregate(F.array_sort(runs), none, add)
    size = (F.size(sums) - 1).cast("double")
    n = found["n"].cast("double")
    return F.when((n > 0) & (n < size), F.abs(found["sum"]) / F.sqrt(n - n * n / size))


def values(candidates: DataFrame, sums: DataFrame, keys: Sequence[str], of: Sequence[str]) -> DataFrame:
    """Rows (*keys, *of, value): the mean absolute correlation of a group's series with each candidate's `runs`."""
    met = candidates.join(sums, list(keys)).select(*keys, *of, correlation(F.col("sums"), F.col("runs")).alias("r"))
    return met.groupBy(*keys, *of).agg(F.avg("r").alias("value"))


def chosen_alone(candidates: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """candidates (*keys, event, k, x, run) -> the x of the best for each event; the first if none has a value.

    Candidates that cover the same samples are one candidate.
    """
    once = candidates.groupBy(*keys, "event", "run").agg(F.min(F.struct("k", "x")).alias("c"))
    valued = values(once.withColumn("runs", F.array("run")), sums, keys, ["event", "c"])
    order = F.struct((-F.round(F.coalesce("value", F.lit(-1.0)), DIGITS)).alias("worse"), F.col("c.k").alias("k"))
    return valued.groupBy(*keys, "event").agg(F.min_by("c.x", order).alias("x"))


def joint_search(series: DataFrame, keys: Sequence[str], stimuli: DataFrame, lags: Sequence[float], durations: Sequence[float], step: float = 0.01, column: str = "y", rounds: int = 10_000) -> DataFrame:
    """Rows (*keys, times, events, lags, durations, value, moves): where each group's search ends, and how many moves it took.

    series: keys and the column; a row for each series. stimuli: keys (or some of them), `times` of the samples and `events`, the stimulus times.
    lags and durations are the values tried alone.
    """
    steps = Steps(series.sparkSession, "lags")
    sums = prefix_sums(series.select(*keys, column), column).persist()
    try:
        groups = sums.select(*keys).distinct().join(stimuli, [k for k in keys if k in stimuli.columns]).select(*keys, "times", "events")

        def tried(xs):
            return F.posexplode(F.array(*[F.lit(float(x)) for x in xs])).alias("k", "x")

        events = groups.select(*keys, "times", F.posexplode("events").alias("event", "at"))
        by_lag = events.select("*", tried(lags)).withColumn("run", covered(F.col("times"), F.col("at") + F.col("x"), F.col("at") + F.col("x") + 1.0))
        lag = chosen_alone(by_lag, sums, keys).withColumnRenamed("x", "lag")
        placed = steps.save(events.join(lag, [*keys, "event"]))
        start = F.col("at") + F.col("lag")
        by_length = placed.select("*", tried(durations)).withColumn("run", covered(F.col("times"), start, start + F.col("x")))
        both = placed.join(chosen_alone(by_length, sums, keys), [*keys, "event"])
        each = F.array_sort(F.collect_list(F.struct("event", "lag", F.col("x").alias("duration"))))
        begun = groups.join(both.groupBy(*keys).agg(each.alias("found")), list(keys))
        begun = begun.select(*keys, "times", "events", F.col("found.lag").alias("lags"), F.col("found.duration").alias("durations"))
        first = values(begun.withColumn("runs", runs_of("lags", "durations")), sums, keys, [])
        state = steps.save(begun.join(first, list(keys)).withColumns({"after": F.lit(0), "moves": F.lit(0), "moved": F.lit(True)}))
        for _ in range(rounds):
            active = state.filter("moved")
            if active.isEmpty():
                steps.forget()
                return state.select(*keys, "times", "events", "lags", "durations", "value", "moves")
            state = steps.save(moved(active, sums, keys, step).unionByName(state.filter("NOT moved")))
            steps.forget(2)
        raise RuntimeError(f"the lag search has not settled after {rounds} moves")
    finally:
        sums.unpersist()


def runs_of(lags: str, durations: str) -> Column:
    """The runs that the boxcars of all stimuli cover."""
    return F.transform(F.arrays_zip("events", lags, durations), lambda s: covered(F.col("times"), s["events"] + s[lags], s["events"] + s[lags] + s[durations]))


def moved(state: DataFrame, sums: DataFrame, keys: Sequence[str], step: float) -> DataFrame:
    """Each group after its first better move behind the last one taken; `moved` is false where none is better."""
    count = F.size("events") * len(MOVES)
    moves = state.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("move"))
    event, kind = F.floor(F.col("move") / len(MOVES)), F.col("move") % len(MOVES)

    def changed(name: str, part: int) -> Column:
        by = F.element_at(F.array(*[F.lit(step * m[part]) for m in MOVES]), (kind + 1).cast("int"))
        return F.transform(name, lambda x, k: F.when(k == event, x + by).otherwise(x))

    tries = moves.withColumns({"new_lags": changed("lags", 0), "new_durations": changed("durations", 1)})
    found = values(tries.withColumn("runs", runs_of("new_lags", "new_durations")), sums, keys, ["move"])
    better = tries.join(found.withColumnRenamed("value", "new_value"), [*keys, "move"]).filter(F.col("new_value") > F.col("value") + BETTER)
    taken = F.struct("new_lags", "new_durations", "new_value", "move")
    best = better.groupBy(*keys).agg(F.min_by(taken, F.pmod(F.col("move") - F.col("after"), count)).alias("best"))
    out = state.join(best, list(keys), "left")
    take = F.col("best").isNotNull()
    return out.select(
        *keys, "times", "events",
        *[F.when(take, F.col(f"best.new_{c}")).otherwise(F.col(c)).alias(c) for c in ("lags", "durations", "value")],
        F.when(take, F.pmod(F.col("best.move") + 1, count)).otherwise(F.col("after")).cast("int").alias("after"),
        (F.col("moves") + take.cast("int")).alias("moves"), take.alias("moved"),
    )


def regressor(times: str = "times", events: str = "events", lags: str = "lags", durations: str = "durations") -> Column:
    """The regressor of a found state: 1 at the samples that a boxcar covers, else 0."""
    boxes = F.arrays_zip(events, lags, durations)
    inside = lambda t: F.exists(boxes, lambda s: (t >= s[events] + s[lags]) & (t <= s[events] + s[lags] + s[durations]))
    return F.transform(times, lambda t: F.when(inside(t), 1.0).otherwise(0.0))
