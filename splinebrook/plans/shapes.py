"""Queries of component shapes and group trees: thinned peaks, orientations, average linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agglomerate as A, orientation as O, peaks as K, rsa
from ..sources import tables as tab
from .catalog import _DIST, _ROI_SERIES, EV, LONG, QUERIES, ORACLES, _roi_series, query, r6

_PEAKS = "SELECT {keys}, t, y FROM (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS n FROM ({series}) WINDOW w AS (PARTITION BY {keys} ORDER BY t)) WHERE y > p AND y > n"


def thinned_sql(series: str, keys: str, distance: int) -> str:
    """The greedy choice in rounds: what no higher peak reaches stays, what it reaches goes."""
    reach = f"abs(a.t - b.t) < {distance}"
    higher = "(b.y > a.y OR (b.y = a.y AND b.t < a.t))"
    return f"""WITH RECURSIVE pk AS MATERIALIZED ({_PEAKS.format(keys=keys, series=series)}),
 g AS (SELECT {keys}, t, y, FALSE AS stays, 0 AS n FROM pk
   UNION ALL SELECT {keys}, t, y, stays, n FROM (
     SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.t, a.y, a.n + 1 AS n, NOT EXISTS (SELECT 1 FROM g b WHERE NOT b.stays AND {' AND '.join(f'b.{k.strip()} = a.{k.strip()}' for k in keys.split(','))} AND {reach} AND {higher}) AS stays,
       EXISTS (SELECT 1 FROM g b WHERE b.stays AND {' AND '.join(f'b.{k.strip()} = a.{k.strip()}' for k in keys.split(','))} AND {reach}) AS gone FROM g a WHERE NOT a.stays) WHERE NOT gone)
 SELECT {keys}, CAST(t AS BIGINT) AS t, round(y, 6) + 0.0 AS height FROM g WHERE stays"""


DISTANCE = 5


@query(thinned_sql(_ROI_SERIES, "roi", DISTANCE))
def w4_thinned_peaks(spark, d):
    """Maxima of the regions' series, none within five samples of a higher one."""
    return K.thinned(_roi_series(spark, d), ["roi"], DISTANCE).select("roi", "t", r6("y", "height"))


_ONE = f"SELECT 0 AS series, voxel_id * 64 + t AS t, round(y, 9) AS y FROM ({LONG})"


@query(thinned_sql(_ONE, "series", 9))
def w4_long_series(spark, d):
    """The same of one long series, all voxels' values one after the other."""
    s = tab.to_long(tab.signals(spark, d)).select(F.lit(0).alias("series"), (F.col("voxel_id") * 64 + F.col("t")).alias("t"), F.round("y", 9).alias("y"))
    return K.thinned(s, ["series"], 9).select("series", "t", r6("y", "height"))


@query(f"""WITH RECURSIVE f AS MATERIALIZED ({ORACLES["r4_oriented_dtw"]}), nodes AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS k, count(*) OVER () AS n FROM (SELECT i AS node FROM f UNION SELECT j FROM f)),
 w AS MATERIALIZED (SELECT a.k AS a, list(CASE WHEN a.node = b.node THEN 0.0 WHEN f.flipped THEN -1.0 ELSE 1.0 END ORDER BY b.k) AS row FROM nodes a CROSS JOIN nodes b LEFT JOIN f ON (f.i = a.node AND f.j = b.node) OR (f.i = b.node AND f.j = a.node) GROUP BY a.k),
 mat AS MATERIALIZED (SELECT list(CAST(row AS DOUBLE[]) ORDER BY a) AS m FROM w),
 v AS (SELECT 0 AS it, (SELECT list(CAST(('0x' || substr(md5(CAST(node AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 ORDER BY k) FROM nodes) AS x
   UNION ALL SELECT it + 1, list_transform(y, lambda a: a / sqrt(list_dot_product(y, y))) FROM (SELECT it, list_transform(m, lambda r, k: list_dot_product(r, CAST(x AS DOUBLE[])) + len(m) * x[k]) AS y FROM v, mat WHERE it < 200))
 SELECT node, x[k] < 0 AS flip FROM nodes, v WHERE it = 200""")
def r5_orientations(spark, d):
    """Which regions' series to turn, from the pairs that match better turned."""
    return O.orientations(QUERIES["r4_oriented_dtw"](spark, d)).select("node", "flip")


_GROUPS = 10
_TEN = f"SELECT DISTINCT user_id AS id, CAST(user_id % {_GROUPS} AS BIGINT) AS label FROM ({EV})"
_TEN_DIST = f"SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, round(avg(d), 9) AS d FROM ({_DIST}) JOIN ({_TEN}) a ON a.id = i JOIN ({_TEN}) b ON b.id = j WHERE a.label <> b.label GROUP BY ALL"
#: The tree one merge at a time: w is the table of distances after it merges.
_TREE = f"""WITH RECURSIVE first AS MATERIALIZED ({_TEN_DIST}),
 w AS (SELECT 0 AS it, a, b, d, CAST(1 AS BIGINT) AS na, CAST(1 AS BIGINT) AS nb FROM first
   UNION ALL SELECT it + 1, lo, hi, sum(d * na * nb) / sum(na * nb), CASE WHEN lo = ma THEN size ELSE any_value(nlo) END, CASE WHEN hi = ma THEN size ELSE any_value(nhi) END FROM (
     SELECT *, least(u, v) AS lo, greatest(u, v) AS hi, CASE WHEN u < v THEN na ELSE nb END AS nlo, CASE WHEN u < v THEN nb ELSE na END AS nhi FROM (
       SELECT w.*, ma, size, CASE WHEN w.a = mb THEN ma ELSE w.a END AS u, CASE WHEN w.b = mb THEN ma ELSE w.b END AS v FROM w CROSS JOIN (SELECT a AS ma, b AS mb, na + nb AS size FROM w ORDER BY round(d, {A.DIGITS}), a, b LIMIT 1)) WHERE u <> v) GROUP BY it, ma, size, lo, hi),
 merges AS MATERIALIZED (SELECT it, a, b, d, na + nb AS size FROM w QUALIFY row_number() OVER (PARTITION BY it ORDER BY round(d, {A.DIGITS}), a, b) = 1)
"""


def _linked(spark, d):
    """Ten groups of subjects by their mean correlation distances."""
    labels = tab.table(spark, d, "events").select(F.col("user_id").alias("id"), (F.col("user_id") % _GROUPS).alias("label")).distinct()
    means = rsa.group_distances(tab.subject_days(spark, d), labels, "user_id", "y").filter("label_i <> label_j")
    return A.average_linkage(means.select(F.col("label_i").alias("a"), F.col("label_j").alias("b"), F.round("d", 9).alias("d")))


@query(_TREE + "SELECT a, b, round(d, 6) + 0.0 AS height, CAST(size AS BIGINT) AS size FROM merges")
def r11_linkage(spark, d):
    """The merges of average linkage."""
    merges, _ = _linked(spark, d)
    return merges.select("a", "b", r6("height", "height"), "size")


@query(_TREE + """, named AS (SELECT 0 AS it, label AS node, label AS cluster FROM (SELECT a AS label FROM first UNION SELECT b FROM first)
   UNION ALL SELECT n.it + 1, node, CASE WHEN cluster = m.b THEN m.a ELSE cluster END FROM named n JOIN merges m ON m.it = n.it WHERE n.it + 1 < (SELECT count(*) FROM merges))
 SELECT node, cluster FROM named WHERE it = (SELECT count(*) - 1 FROM merges)""")
def r11_two_clusters(spark, d):
    """The two clusters before the last merge."""
    return A.two_clusters(*_linked(spark, d)).select("node", "cluster")
