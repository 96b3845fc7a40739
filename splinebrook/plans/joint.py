"""Queries of the joint lag search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lags as L
from ..sources import tables as tab
from .catalog import SIG, VOLUMES, query, r6

HALF, TR = VOLUMES // 2, 0.75
TIMES = [k * TR for k in range(HALF)]
#: Stimulus times of the two movements, and the lags and durations that are tried alone.
EVENTS = ((3.0, 9.75, 16.5), (5.25, 15.0))
STEP = 0.25
LAGS = [-3.0 + k * STEP for k in range(25)]
DURATIONS = [1.0 + k * STEP for k in range(17)]


def _list(values) -> str:
    return "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values) + "]"


_COVER = "list_transform(ts, lambda t: CASE WHEN len(list_filter(range(1, len({0}) + 1), lambda i: t >= {0}[i] + {1}[i] AND t <= {0}[i] + {1}[i] + {2}[i])) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
_R = "CASE WHEN list_sum(g) > 0 AND list_sum(g) < len(g) THEN abs(list_dot_product(x, g)) / sqrt(list_sum(g) - list_sum(g) * list_sum(g) / len(g)) END"
#: Files as series of mean 0 and length 1, stimuli by movement, and what is tried alone, each event at a time.
_SEARCH = f"""WITH RECURSIVE files AS MATERIALIZED (SELECT pc, movement, list_transform(c, lambda v: v / n) AS x FROM (SELECT *, sqrt(list_dot_product(c, c)) AS n FROM (
   SELECT roi AS pc, movement, list_transform(y, lambda v: v - list_avg(y)) AS c FROM (SELECT roi, movement, y[(movement - 1) * {HALF} + 1 : movement * {HALF}] AS y FROM ({SIG}) CROSS JOIN (SELECT unnest([1, 2]) AS movement)))) WHERE n > 1e-12),
 grp AS MATERIALIZED (SELECT DISTINCT pc, movement, CASE movement WHEN 1 THEN {_list(EVENTS[0])} ELSE {_list(EVENTS[1])} END AS ev, {_list(TIMES)} AS ts FROM files),
 one AS MATERIALIZED (SELECT *, ev[e] AS moment FROM (SELECT *, unnest(range(1, len(ev) + 1)) AS e FROM grp)),
 t1 AS (SELECT pc, movement, e, k, {_COVER.format("[moment]", "[lag]", "[CAST(1 AS DOUBLE)]")} AS g, lag FROM (SELECT *, {_list(LAGS)}[k] AS lag FROM (SELECT *, unnest(range(1, {len(LAGS)} + 1)) AS k FROM one))),
 v1 AS (SELECT pc, movement, e, k, lag, avg({_R}) AS v FROM t1 JOIN files USING (pc, movement) GROUP BY ALL),
 b1 AS MATERIALIZED (SELECT pc, movement, e, lag FROM v1 QUALIFY row_number() OVER (PARTITION BY pc, movement, e ORDER BY round(coalesce(v, -1), {L.DIGITS}) DESC, k) = 1),
 t2 AS (SELECT pc, movement, e, k, lag, dur, {_COVER.format("[moment]", "[lag]", "[dur]")} AS g FROM (SELECT *, {_list(DURATIONS)}[k] AS dur FROM (SELECT *, unnest(range(1, {len(DURATIONS)} + 1)) AS k FROM one JOIN b1 USING (pc, movement, e)))),
 v2 AS (SELECT pc, movement, e, k, lag, dur, avg({_R}) AS v FROM t2 JOIN files USING (pc, movement) GROUP BY ALL),
 b2 AS (SELECT pc, movement, e, lag, dur FROM v2 QUALIFY row_number() OVER (PARTITION BY pc, movement, e ORDER BY round(coalesce(v, -1), {L.DIGITS}) DESC, k) = 1),
 s0 AS (SELECT pc, movement, any_value(ev) AS ev, any_value(ts) AS ts, list(lag ORDER BY e) AS lags, list(dur ORDER BY e) AS durs FROM b2 JOIN grp USING (pc, movement) GROUP BY pc, movement),
 s1 AS MATERIALIZED (SELECT pc, movement, ev, ts, lags, durs, avg({_R}) AS v FROM (SELECT *, {_COVER.format("ev", "lags", "durs")} AS g FROM s0) JOIN files USING (pc, movement) GROUP BY ALL),
 walk AS (SELECT pc, movement, ev, ts, lags, durs, v, 0 AS after, 0 AS n FROM s1
   UNION ALL SELECT pc, movement, ev, ts, nl, nd, nv, (m + 1) % (4 * len(ev)), n + 1 FROM (
     SELECT *, row_number() OVER (PARTITION BY pc, movement ORDER BY (m - after + 4 * len(ev)) % (4 * len(ev))) AS nth FROM (
       SELECT pc, movement, ev, ts, v, after, n, m, nl, nd, avg({_R}) AS nv FROM (
         SELECT *, {_COVER.format("ev", "nl", "nd")} AS g FROM (
           SELECT *, list_transform(lags, lambda l, i: CASE WHEN i = m // 4 + 1 THEN l + ([{STEP}, -{STEP}, 0, 0])[m % 4 + 1] ELSE l END) AS nl, list_transform(durs, lambda l, i: CASE WHEN i = m // 4 + 1 THEN l + ([0, 0, {STEP}, -{STEP}])[m % 4 + 1] ELSE l END) AS nd
           FROM (SELECT *, unnest(range(0, 4 * len(ev))) AS m FROM walk))) JOIN files USING (pc, movement) GROUP BY ALL) WHERE nv > v + {L.BETTER!r}) WHERE nth = 1),
 ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY pc, movement ORDER BY n DESC) = 1)
"""


def _found(spark, d):
    """Regions as components, halves of the volumes as movements, and a region's voxels as the files of both."""
    y = tab.signals(spark, d).select(F.col("roi").alias("pc"), "y")
    halves = F.array(*[F.struct(F.lit(k + 1).alias("movement"), F.slice("y", k * HALF + 1, HALF).alias("y")) for k in (0, 1)])
    files = y.select("pc", F.explode(halves).alias("h")).select("pc", "h.movement", "h.y")
    stimuli = spark.createDataFrame([(k + 1, TIMES, list(e)) for k, e in enumerate(EVENTS)], "movement int, times array<double>, events array<double>")
    return L.joint_search(files, ["pc", "movement"], stimuli, LAGS, DURATIONS, STEP)


@query(_SEARCH + "SELECT pc, movement, CAST(e AS INTEGER) AS event, round(lag, 6) + 0.0 AS lag, round(dur, 6) + 0.0 AS duration, round(v, 6) + 0.0 AS mean_abs_r, n AS moves FROM (SELECT *, unnest(range(1, len(ev) + 1)) AS e, unnest(lags) AS lag, unnest(durs) AS dur FROM ends)")
def t8_joint_lags(spark, d):
    """Lags and durations of all stimuli of a movement, found together for each component."""
    each = F.posexplode(F.arrays_zip("lags", "durations")).alias("k", "b")
    found = _found(spark, d).select("pc", "movement", "value", "moves", each)
    return found.select("pc", "movement", (F.col("k") + 1).alias("event"), r6("b.lags", "lag"), r6("b.durations", "duration"), r6("value", "mean_abs_r"), "moves")


@query(_SEARCH + f"""SELECT pc, movement, CAST(t AS INTEGER) AS t, CAST(g[t + 1] AS DOUBLE) AS regressor FROM (SELECT *, {_COVER.format("ev", "lags", "durs")} AS g, unnest(range(0, {HALF})) AS t FROM ends)""")
def t8_joint_regressors(spark, d):
    """The regressors that the joint search ends with."""
    found = _found(spark, d).select("pc", "movement", F.posexplode(L.regressor()).alias("t", "regressor"))
    return found.select("pc", "movement", "t", "regressor")
