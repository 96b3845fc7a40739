import numpy as np
import pytest

from splinebrook.operators import lags as L

TR, N = 0.75, 40
TIMES = np.arange(N) * TR
EVENTS = {1: [3.0, 12.0, 21.0], 2: [6.0, 17.25]}
LAGS, DURATIONS, STEP = np.arange(-3, 3.01, 0.25), np.arange(1, 6.01, 0.25), 0.75


def box(events, lags, durations):
    out = np.zeros(N)
    for e, lag, d in zip(events, lags, durations, strict=True):
        out[(TIMES >= e + lag) & (TIMES <= e + lag + d)] = 1
    return out


def value(x, reg):
    if reg.min() == reg.max():
        return None
    return np.mean([abs(np.corrcoef(y, reg)[0, 1]) for y in x if y.std() > 0])


def slow_search(x, events):
    lags, durations = [], []
    for e in events:
        tried = [value(x, box([e], [lag], [1.0])) for lag in LAGS]
        lags.append(LAGS[max(range(len(LAGS)), key=lambda k: (round(-1 if tried[k] is None else tried[k], 9), -k))])
        tried = [value(x, box([e], lags[-1:], [d])) for d in DURATIONS]
        durations.append(DURATIONS[max(range(len(DURATIONS)), key=lambda k: (round(-1 if tried[k] is None else tried[k], 9), -k))])
    now, moves, improved = value(x, box(events, lags, durations)), 0, True
    while improved:
        improved = False
        for e in range(len(events)):
            for a, b in ((STEP, 0), (-STEP, 0), (0, STEP), (0, -STEP)):
                new_lags, new_durations = list(lags), list(durations)
                new_lags[e] += a
                new_durations[e] += b
                new = value(x, box(events, new_lags, new_durations))
                if new is not None and new > now + 1e-9:
                    lags, durations, now, moves, improved = new_lags, new_durations, new, moves + 1, True
    return lags, durations, now, moves


@pytest.fixture(scope="module")
def files():
    rng = np.random.default_rng(4)
    out = {}
    for pc in (1, 2):
        for m, events in EVENTS.items():
            shape = box(events, rng.uniform(-2, 2, len(events)), rng.uniform(2, 5, len(events)))
            out[pc, m] = [s * shape + rng.standard_normal(N) * 0.8 for s in (1, -1, 2)]
    out[1, 1].append(np.ones(N))
    return out


def searched(spark, files, events=EVENTS):
    rows = [(pc, m, [float(v) for v in y]) for (pc, m), ys in files.items() for y in ys]
    series = spark.createDataFrame(rows, "pc int, movement int, y array<double>")
    stimuli = spark.createDataFrame([(m, TIMES.tolist(), e) for m, e in events.items()], "movement int, times array<double>, events array<double>")
    return L.joint_search(series, ["pc", "movement"], stimuli, LAGS.tolist(), DURATIONS.tolist(), STEP)


def test_against_one_by_one(spark, files):
    found = searched(spark, files)
    got = {(r.pc, r.movement): r for r in found.withColumn("reg", L.regressor()).collect()}
    assert got.keys() == files.keys()
    for key, ys in files.items():
        lags, durations, best, moves = slow_search(ys, EVENTS[key[1]])
        r = got[key]
        assert r.lags == pytest.approx(lags) and r.durations == pytest.approx(durations)
        assert r.value == pytest.approx(best) and r.moves == moves
        assert r.reg == box(EVENTS[key[1]], lags, durations).tolist()
    assert max(r.moves for r in got.values()) > 1


def test_groups_without_stimuli_or_spread(spark, files):
    some = {(1, 1): [np.zeros(N)], (1, 2): files[1, 2], (2, 3): files[2, 1]}
    assert [(r.pc, r.movement) for r in searched(spark, some).collect()] == [(1, 2)]
    assert searched(spark, some, {9: [1.0]}).count() == 0


def test_stimuli_outside_the_series(spark, files):
    """Candidates that cover nothing have no value and are never taken; without any value the first candidates stay."""
    r = searched(spark, {(1, 1): files[1, 1]}, {1: [900.0]}).first()
    assert r.value is None and r.lags == [LAGS[0]] and r.durations == [DURATIONS[0]] and r.moves == 0


def test_overlapping_boxes_count_once(spark):
    y = spark.createDataFrame([(0, [0.0, 1.0, 4.0, 2.0, 1.0])], "g int, y array<double>")
    from pyspark.sql import functions as F

    runs = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("stop")) for a, b in ((2, 4), (1, 3), (4, 4))])
    got = L.prefix_sums(y).select(L.correlation(F.col("sums"), runs)).first()[0]
    assert got == pytest.approx(abs(np.corrcoef([0, 1, 4, 2, 1], [0, 1, 1, 1, 0])[0, 1]))
