"""Named queries over the driver's tables, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.basis import evaluate, knots, lambdas, penalty, times
from ..operators import classify, compare, crossval, fpca, learning, relational as R, rsa, similarity as S, timeseries as T
from ..sources import tables as tab
from . import group_tests as G, spline_sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed parameters of the queries.
VOLUMES, K, DEGREE, TR = 64, 12, 3, 0.75
FIXED_LAMBDA = 10.0
FEW_LAMBDAS = (1e-2, 1.0, 1e2, 1e4, 1e6)
STIMULI = ((6.0, 6.0), (24.0, 9.0))
PAIR = ("BUILDING", "MACHINERY")
TOP_N = 10
GRID = (10, 10)  # y and z of the voxel grid; x grows with the table
SEGMENTS, TRANSITIONS = ((2, 10), (12, 26)), (8, 20, 27)

SIG = "SELECT vec_id AS voxel_id, label AS roi, CAST(embedding AS DOUBLE[]) AS y FROM embeddings WHERE embedding IS NOT NULL"
LONG = f"SELECT voxel_id, roi, unnest(range(len(y))) AS t, unnest(y) AS y FROM ({SIG})"
DAYS = "SELECT user_id, least(dayofmonth(ts) - 1, 29) AS t, avg(value) AS y FROM events GROUP BY ALL"
EV = f"SELECT u.user_id, g.t, coalesce(d.y, 0.0) AS y FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(30)) AS t) g LEFT JOIN ({DAYS}) d ON d.user_id = u.user_id AND d.t = g.t"
EVR = "SELECT u.user_id, u.roi, g.t, coalesce(d.y, 0.0) AS y FROM (SELECT DISTINCT user_id, event_type AS roi FROM events) u CROSS JOIN (SELECT unnest(range(30)) AS t) g LEFT JOIN (SELECT user_id, event_type AS roi, least(dayofmonth(ts) - 1, 29) AS t, avg(value) AS y FROM events GROUP BY ALL) d ON d.user_id = u.user_id AND d.roi = u.roi AND d.t = g.t"
MD = "SELECT c_custkey AS sub_id, c_mktsegment AS instrument_group, n_name AS grp, CAST(c_custkey % 2 AS INTEGER) AS is_train_set, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey"
RS0 = "SELECT o_custkey AS subject, l_returnflag || l_linestatus AS roi, (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS t, sum(l_extendedprice) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
RS = f"SELECT u.subject, r.roi, g.t, coalesce(d.y, 0.0) AS y FROM (SELECT DISTINCT subject FROM ({RS0})) u CROSS JOIN (SELECT unnest(['AF','AO','NF','NO','RF','RO']) AS roi) r CROSS JOIN (SELECT unnest(range(28)) AS t) g LEFT JOIN ({RS0}) d ON d.subject = u.subject AND d.roi = r.roi AND d.t = g.t"
IMP = "SELECT l_returnflag || ' vs ' || l_linestatus AS pair, o_orderpriority AS ml_model, p_brand AS roi, round(avg(l_discount * l_quantity), 9) AS importance FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"
RANKED = f"SELECT *, row_number() OVER (PARTITION BY pair, ml_model ORDER BY importance DESC, roi DESC) AS rank FROM ({IMP})"
TOP = f"SELECT * FROM ({RANKED}) WHERE rank <= {TOP_N}"
#: Importances have nine decimals, so their sums are exact as decimals and a mean does not depend on the order of rows.
MEAN = "round(CAST(sum(CAST(importance AS DECIMAL(28, 9))) AS DOUBLE) / count(importance), 6) + 0.0 AS mean_importance"
PRED = "SELECT l.doc_id, d.lang AS grp, l.quality AS y, n_chars / (n_chars + 2000) AS score, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def query(sql: str | None = None):
    """Register a function under its name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str, digits: int = 6):
    return C.rounded(c, digits).alias(name)


def values_sql(m: np.ndarray) -> str:
    """A matrix as rows (i, j, v)."""
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, CAST({float(m[i, j])!r} AS DOUBLE))" for i in range(m.shape[0]) for j in range(m.shape[1])) + ") AS m(i, j, v)"


def regressor() -> list[float]:
    return T.regressor_values(times(VOLUMES, 0, TR), list(STIMULI))


def base_smoother() -> fpca.Smoother:
    return fpca.smoother_for(VOLUMES, K, DEGREE, 2, TR)


# --- aggregations of the signal matrix -----------------------------------------------------------------------------


@query(f"SELECT t, round(avg(y), 6) + 0.0 AS mean_value FROM ({LONG}) GROUP BY t")
def a5_mean_signal(spark, d):
    s = tab.signals(spark, d)
    means = [F.avg(F.element_at("y", k + 1)) for k in range(VOLUMES)]
    return s.agg(F.array(*means).alias("m")).select(F.posexplode("m").alias("t", "v")).select(F.col("t").cast("long").alias("t"), r6("v", "mean_value"))


@query(f"SELECT voxel_id, CAST(len(y) - 16 AS INTEGER) AS n, round(y[5], 6) + 0.0 AS first_y, round(y[len(y) - 12], 6) + 0.0 AS last_y FROM ({SIG})")
def p2_crop_volumes(spark, d):
    s = tab.signals(spark, d).select("voxel_id", C.crop("y", 4, 12).alias("c"))
    return s.select("voxel_id", F.size("c").alias("n"), r6(F.element_at("c", 1), "first_y"), r6(F.element_at("c", -1), "last_y"))


@query(f"WITH m AS (SELECT roi, t, avg(y) AS v FROM ({LONG}) GROUP BY ALL) SELECT CAST(r.roi AS INTEGER) AS roi, g.t, round(coalesce(v, 0), 6) + 0.0 AS value FROM (SELECT unnest(range(12)) AS roi) r CROSS JOIN (SELECT unnest(range({VOLUMES})) AS t) g LEFT JOIN m ON m.roi = r.roi AND m.t = g.t")
def a6_roi_mean_series(spark, d):
    """Twelve regions, two of which have no voxels."""
    rois = spark.range(12).select(F.col("id").cast("int").alias("roi"))
    found = R.roi_means(tab.to_long(tab.signals(spark, d)), rois)
    return found.select("roi", F.col("t").cast("long").alias("t"), r6("value", "value"))


@query(f"SELECT CAST(r.roi AS INTEGER) AS roi, round(coalesce(avg(list_avg(y)), 0), 6) + 0.0 AS weight FROM (SELECT unnest(range(12)) AS roi) r LEFT JOIN ({SIG}) s ON s.roi = r.roi GROUP BY r.roi")
def a7_roi_mean_weight(spark, d):
    """Mean of a map (each voxel's mean over its volumes) over each region, 0 for an empty one."""
    rois = spark.range(12).select(F.col("id").cast("int").alias("roi"))
    w = tab.signals(spark, d).groupBy("roi").agg(F.avg(C.mean_of("y")).alias("w"))
    return rois.join(w, "roi", "left").select("roi", r6(F.coalesce("w", F.lit(0.0)), "weight"))


@query(f"SELECT t AS k, round(sum(s) / sum(n), 6) + 0.0 AS mean FROM (SELECT voxel_id % 2 AS subject, t, sum(y) AS s, count(*) AS n FROM ({LONG}) GROUP BY ALL) GROUP BY t")
def a1_global_mean(spark, d):
    """Voxel-weighted mean over subjects; a subject is a parity of the voxel id."""
    n, total, _ = fpca.moments(tab.signals(spark, d), "y")
    return spark.createDataFrame([(k, float(v) / n) for k, v in enumerate(total)], "k long, m double").select("k", r6("m", "mean"))


@query(f"WITH m AS (SELECT t, avg(y) AS m FROM ({LONG}) GROUP BY t), c AS (SELECT voxel_id, l.t, y - m AS y FROM ({LONG}) l JOIN m ON l.t = m.t) SELECT a.t AS i, b.t AS j, round(sum(a.y * b.y) / (SELECT count(*) FROM ({SIG})), 8) + 0.0 AS cov FROM c a JOIN c b ON a.voxel_id = b.voxel_id GROUP BY ALL")
def a2_pooled_covariance(spark, d):
    n, total, outer = fpca.moments(tab.signals(spark, d), "y")
    cov = outer / n - np.outer(total / n, total / n)
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(rows, "i long, j long, v double").select("i", "j", r6("v", "cov", 8))


@query(f"SELECT round(sum(v), 6) + 0.0 AS total_variance FROM (SELECT t, var_pop(y) AS v FROM ({LONG}) GROUP BY t)")
def a28_total_variance(spark, d):
    model = fpca.FpcaModel.fit(tab.signals(spark, d), 1, column="y")
    return spark.createDataFrame([(model.total,)], "v double").select(r6("v", "total_variance"))


@query(f"""WITH RECURSIVE m AS (SELECT t, avg(y) AS m FROM ({LONG}) GROUP BY t),
 c AS (SELECT voxel_id, l.t, y - m AS y FROM ({LONG}) l JOIN m ON l.t = m.t),
 cov AS (SELECT a.t AS i, b.t AS j, sum(a.y * b.y) / (SELECT count(*) FROM ({SIG})) AS v FROM c a JOIN c b ON a.voxel_id = b.voxel_id GROUP BY ALL),
 r0 AS (SELECT i, list(v ORDER BY j) AS row FROM cov GROUP BY i), rowsl AS (SELECT list(row ORDER BY i) AS rows FROM r0),
 it AS (SELECT 0 AS n, CAST([1.0 + 0.01 * x FOR x IN range({VOLUMES})] AS DOUBLE[]) AS v, 0.0::DOUBLE AS e UNION ALL
  SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))), list_dot_product(v, w) / list_dot_product(v, v) FROM (SELECT n, v, list_transform(rows, lambda r: list_dot_product(r, v)) AS w FROM it, rowsl WHERE n < 1500))
 SELECT round(e, 5) + 0.0 AS eigval FROM it WHERE n = 1500""")
def n14_leading_eigenvalue(spark, d):
    model = fpca.FpcaModel.fit(tab.signals(spark, d), 1, column="y")
    return spark.createDataFrame([(float(model.values[0]),)], "v double").select(r6("v", "eigval", 5))


def _smoothed(lams=(FIXED_LAMBDA,), metric: bool = False) -> str:
    return "WITH RECURSIVE " + Q.smoothing(VOLUMES, TR, K, DEGREE, 2, lams, metric)


_FIXED = f"{_smoothed()}, {Q.gcv(SIG, VOLUMES, K)}, curve AS (SELECT voxel_id, t, list_dot_product(c, b) AS fit FROM fit, f WHERE n = 1)"


@query(f"{_FIXED} SELECT voxel_id, unnest(range({K})) AS k, round(unnest(c), 6) + 0.0 AS c FROM fit WHERE n = 1")
def n9_fit_no_lambda_search(spark, d):
    fitted = fpca.fit_series(tab.signals(spark, d), base_smoother(), np.array([FIXED_LAMBDA]))
    return fitted.select("voxel_id", F.posexplode("c").alias("k", "v")).select("voxel_id", F.col("k").cast("long").alias("k"), r6("v", "c"))


@query(f"{_smoothed(FEW_LAMBDAS)}, {Q.gcv(SIG, VOLUMES, K)} SELECT voxel_id, la AS chosen, round(gcv, 8) + 0.0 AS gcv FROM fit WHERE n = 1")
def n9_gcv_select(spark, d):
    fitted = fpca.fit_series(tab.signals(spark, d), base_smoother(), np.array(FEW_LAMBDAS))
    return fitted.select("voxel_id", F.col("lambda").alias("chosen"), r6("gcv", "gcv", 8))


@query(f"{_FIXED} SELECT round(avg(abs(y - fit)), 6) + 0.0 AS mean_error FROM ({LONG}) l JOIN curve h ON h.voxel_id = l.voxel_id AND h.t = l.t")
def a8_mean_abs_error(spark, d):
    e = fpca.fit_error(tab.signals(spark, d).select("y"), base_smoother(), np.array([FIXED_LAMBDA]))
    return spark.createDataFrame([(e,)], "v double").select(r6("v", "mean_error"))


@query(f"{_FIXED} SELECT voxel_id, t, round(fit, 6) + 0.0 AS fit FROM curve")
def t10_reconstruct(spark, d):
    """The fitted curves at the times of the volumes."""
    s = base_smoother()
    fitted = fpca.fit_series(tab.signals(spark, d), s, np.array([FIXED_LAMBDA])).select("voxel_id", "c")
    curves = fpca.map_series(fitted, "c", "y array<double>", lambda c: (fpca.as_lists(c @ s.f.T),))
    return curves.select("voxel_id", F.posexplode("y").alias("t", "v")).select("voxel_id", F.col("t").cast("long").alias("t"), r6("v", "fit"))


@query(Q.band_pass(SIG, VOLUMES, TR, 0.05, 0.3))
def t2_band_pass(spark, d):
    """Forward and backward band-pass of every signal."""
    out = T.preprocess(tab.signals(spark, d).select("voxel_id", "y"), TR, (0.05, 0.3))
    return out.select("voxel_id", F.posexplode("y").alias("t", "v")).select("voxel_id", "t", r6("v", "y"))


@query()
def fpca_explained(spark, d):
    """The flagship: GCV fits of all signals, then their functional principal components."""
    s = base_smoother()
    coeffs = fpca.fit_series(tab.signals(spark, d), s).select("voxel_id", "c")
    model = fpca.FpcaModel.fit(coeffs, 7, penalty(0.0, (VOLUMES - 1) * TR, K, DEGREE, 0), s.f)
    return model.components(spark).select("pc", r6("eigval", "eigval", 9), r6("explained_pct", "explained_pct"))


@query()
def group_fpca_project(spark, d):
    """Components of the even voxels' group; all voxels projected into them."""
    s = base_smoother()
    coeffs = fpca.fit_series(tab.signals(spark, d), s).select("voxel_id", "c")
    model = fpca.FpcaModel.fit(coeffs.filter("voxel_id % 2 = 0"), 5, penalty(0.0, (VOLUMES - 1) * TR, K, DEGREE, 0), s.f)
    return model.transform(coeffs).select("voxel_id", F.posexplode("s").alias("pc", "score")).select("voxel_id", "pc", r6("score", "score"))


_GROUP = f"""{_smoothed(FEW_LAMBDAS, metric=True)}, {Q.gcv(SIG, VOLUMES, K)},
 cov AS MATERIALIZED ({Q.covariance("SELECT 0 AS k, c AS x FROM fit WHERE n = 1 AND voxel_id % 2 = 0", K)}),
 cu AS (SELECT [[list_sum([cov.s[i][l] * u.m[l][j] FOR l IN range(1, {K + 1})]) FOR j IN range(1, {K + 1})] FOR i IN range(1, {K + 1})] AS m FROM cov, u),
 sigma AS MATERIALIZED (SELECT [[(m[i][j] + m[j][i]) / 2 FOR j IN range(1, {K + 1})] FOR i IN range(1, {K + 1})] AS s FROM cu),
 {Q.leading("SELECT 0 AS k, s FROM sigma", K, 3)}"""


def _group_model(spark, d):
    """Coefficients of all voxels with one of a few lambdas each, and the components of the even voxels' group."""
    s = base_smoother()
    coeffs = fpca.fit_series(tab.signals(spark, d), s, np.array(FEW_LAMBDAS)).select("voxel_id", "c")
    return coeffs, fpca.FpcaModel.fit(coeffs.filter("voxel_id % 2 = 0"), 3, penalty(0.0, (VOLUMES - 1) * TR, K, DEGREE, 0), s.f)


@query(f"{_GROUP}, o AS (SELECT list_sum([s[i][i] FOR i IN range(1, {K + 1})]) AS total FROM sigma) " + " UNION ALL ".join(f"SELECT CAST({c} AS INTEGER) AS pc, round(value, 8) + 0.0 AS eigval, round(100 * value / total, 5) + 0.0 AS explained_pct FROM e{c + 1}, o" for c in range(3)))
def n16_group_fpca(spark, d):
    """Eigenvalues of the group of the even voxels, and their part of its variance."""
    _, model = _group_model(spark, d)
    return model.components(spark).select("pc", r6("eigval", "eigval", 8), r6("explained_pct", "explained_pct", 5))


@query(f"{_GROUP} " + " UNION ALL ".join(f"SELECT voxel_id, CAST({c} AS INTEGER) AS pc, round(list_dot_product([c[i] - cov.mean[i] FOR i IN range(1, {K + 1})], [list_dot_product(r, v) FOR r IN u.m]), 6) + 0.0 AS score FROM fit, cov, u, e{c + 1} WHERE n = 1 AND voxel_id % 2 = 1" for c in range(3)))
def n17_project_unseen(spark, d):
    """The odd voxels projected into the components of the even ones' group."""
    coeffs, model = _group_model(spark, d)
    scores = model.transform(coeffs.filter("voxel_id % 2 = 1"))
    return scores.select("voxel_id", F.posexplode("s").alias("pc", "v")).select("voxel_id", "pc", r6("v", "score"))


def _basis_size_sql() -> str:
    grid = [float(x) for x in lambdas()]
    error = "(WITH RECURSIVE {0}, {1}, h AS (SELECT voxel_id, t, list_dot_product(c, b) AS fit FROM fit, f WHERE n = 1) SELECT avg(abs(y - fit)) FROM ({2}) l JOIN h ON h.voxel_id = l.voxel_id AND h.t = l.t)"
    errors = " UNION ALL ".join(f"SELECT {n} AS k, {error.format(Q.smoothing(VOLUMES, TR, n, DEGREE, 2, grid), Q.gcv(SIG, VOLUMES, n), LONG)} AS e" for n in (6, 12, 20))
    return f"WITH x AS MATERIALIZED ({errors}) SELECT CAST(coalesce((SELECT min(k) FROM x WHERE e <= 0.01), (SELECT arg_min(k, e) FROM x)) AS INTEGER) AS n_basis"


@query(_basis_size_sql())
def n13_basis_size(spark, d):
    """The first of three basis sizes with a mean error within the threshold, else the best."""
    k = fpca.choose_basis_size(tab.signals(spark, d), [6, 12, 20], VOLUMES, 0.01, DEGREE, TR)
    return spark.createDataFrame([(k,)], "n_basis int")


def _contrast(pc: int) -> list[float]:
    return [float(np.cos(np.pi * pc * (k + 0.5) / VOLUMES)) for k in range(VOLUMES)]


_SCORES = "SELECT voxel_id, p.i AS pc, sum(p.v * l.y) AS score FROM ({long}) l JOIN ({m}) p ON p.j = l.t GROUP BY ALL".format(long=LONG, m=values_sql(np.array([_contrast(p) for p in range(4)])))


@query(f"SELECT pc, voxel_id, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY pc ORDER BY score DESC, voxel_id) AS n FROM ({_SCORES})) WHERE n = 1")
def o2_best_voxel(spark, d):
    scores = tab.signals(spark, d).select("voxel_id", F.array(*[C.dot(F.col("y"), F.array(*map(F.lit, _contrast(p)))) for p in range(4)]).alias("s"))
    return fpca.best_voxels(scores).select("pc", "voxel_id", r6("score", "score"))


@query(f"SELECT pc, voxel_id, round(score, 6) + 0.0 AS score FROM (SELECT row_number() OVER (PARTITION BY voxel_id ORDER BY pc) - 1 AS pc, voxel_id, score FROM ({_SCORES}) WHERE pc NOT IN (1))")
def p3_skip_components(spark, d):
    """Scores without component 1, the others numbered anew."""
    keep = [p for p in range(4) if p != 1]
    scores = F.array(*[C.dot(F.col("y"), F.array(*map(F.lit, _contrast(p)))) for p in keep])
    return tab.signals(spark, d).select("voxel_id", F.posexplode(scores).alias("pc", "v")).select(F.col("pc").cast("long").alias("pc"), "voxel_id", r6("v", "score"))


@query(f"SELECT voxel_id, (voxel_id // 100) AS x, (voxel_id // 10) % 10 AS y, voxel_id % 10 AS z FROM ({SIG})")
def f6_voxel_coords(spark, d):
    return tab.signals(spark, d).select("voxel_id", *C.voxel_coordinates(F.col("voxel_id"), *GRID))


@query(f"""WITH n AS (SELECT max(voxel_id) // 100 + 1 AS nx FROM ({SIG})), v AS (SELECT voxel_id // 100 AS x, (voxel_id // 10) % 10 AS y, voxel_id % 10 AS z, t, s.y AS value FROM ({LONG}) s),
 g AS (SELECT x, y, z, t FROM (SELECT unnest(range(nx)) AS x FROM n) CROSS JOIN (SELECT unnest(range(10)) AS y) CROSS JOIN (SELECT unnest(range(10)) AS z) CROSS JOIN (SELECT unnest(range({VOLUMES})) AS t)), full_ AS (SELECT g.x, g.y, g.z, g.t, coalesce(value, 0.0) AS value FROM g LEFT JOIN v ON v.x = g.x AND v.y = g.y AND v.z = g.z AND v.t = g.t),
 o AS (SELECT unnest([-1, 0, 1]) AS o)
 SELECT f.x, f.y, f.z, f.t, round(avg(s.value), 6) + 0.0 AS value FROM full_ f CROSS JOIN o a CROSS JOIN o b CROSS JOIN o c CROSS JOIN n JOIN full_ s ON s.t = f.t AND s.x = greatest(0, least(nx - 1, f.x + a.o)) AND s.y = greatest(0, least(9, f.y + b.o)) AND s.z = greatest(0, least(9, f.z + c.o)) GROUP BY f.x, f.y, f.z, f.t""")
def t1_box_smooth(spark, d):
    """Every volume of the signals on the voxel grid, smoothed over 3 x 3 x 3 with the edges repeated."""
    s = tab.signals(spark, d)
    nx = int(s.agg(F.max("voxel_id")).first()[0] // 100 + 1)
    points = s.select(*[c.cast("int") for c in C.voxel_coordinates(F.col("voxel_id"), *GRID)], F.col("y").alias("values")).toDF("x", "y", "z", "values")
    volumes = F.coalesce("values", F.array_repeat(F.lit(0.0), VOLUMES))
    full = T.scatter(points, (nx, *GRID), "values").select(*[F.col(c).cast("int").alias(c) for c in "xyz"], F.posexplode(volumes).alias("t", "value"))
    return T.box_smooth(full, (nx, *GRID)).select(*[F.col(c).cast("long").alias(c) for c in "xyzt"], r6("value", "value"))


def _threshold_mask(spark, d):
    s = tab.signals(spark, d)
    n = F.size("y").cast("double")
    m = s.select(*C.voxel_coordinates(F.col("voxel_id"), *GRID), (F.aggregate("y", F.lit(0.0), lambda a, x: a + x) / n).alias("m")).toDF("x", "y", "z", "m")
    top = s.select(F.max(F.array_max("y")).alias("top"))
    return m.crossJoin(F.broadcast(top)).filter("m > 0.05 * top")


@query(f"SELECT voxel_id // 100 AS x, (voxel_id // 10) % 10 AS y, voxel_id % 10 AS z FROM ({SIG}) s WHERE list_sum(s.y) / len(s.y) > 0.05 * (SELECT max(list_max(s2.y)) FROM ({SIG}) s2)")
def s19_threshold_mask(spark, d):
    return _threshold_mask(spark, d).select("x", "y", "z")


@query(f"SELECT voxel_id, voxel_id % 10 AS z, round(s.y[4], 6) + 0.0 AS value FROM ({SIG}) s WHERE voxel_id % 10 = 5 AND (voxel_id // 10) % 10 BETWEEN 2 AND 7")
def p17_slice_view(spark, d):
    """Plane z = 5 of volume 3, cut to y from 2 to 7."""
    s = tab.signals(spark, d).withColumn("z", F.col("voxel_id") % 10).withColumn("yy", F.floor(F.col("voxel_id") / 10) % 10)
    return s.filter((F.col("z") == 5) & F.col("yy").between(2, 7)).select("voxel_id", "z", r6(F.element_at("y", 4), "value"))


@query(f"SELECT voxel_id, t, round(CASE WHEN n > 0 THEN y / n ELSE y END, 6) + 0.0 AS y FROM (SELECT voxel_id, t, y, sqrt(sum(y * y) OVER (PARTITION BY voxel_id)) AS n FROM ({LONG}))")
def f10_l2_normalise(spark, d):
    s = tab.signals(spark, d).select("voxel_id", C.l2_normalised("y").alias("y"))
    return s.select("voxel_id", F.posexplode("y").alias("t", "v")).select("voxel_id", F.col("t").cast("long").alias("t"), r6("v", "y"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) + 0.0 AS mean_value, bool_or(y <= 0) AS any_not_positive, bool_or(y <= -1e-6) AS any_negative FROM ({LONG})")
def a25_value_stats(spark, d):
    """Mean and sign statistics over all values."""
    v = F.col("v")
    return tab.signals(spark, d).select(F.explode("y").alias("v")).agg(F.count("v").alias("n"), r6(F.avg(v), "mean_value"), F.bool_or(v <= 0).alias("any_not_positive"), F.bool_or(v <= -1e-6).alias("any_negative"))


@query(f"WITH m AS (SELECT t, avg(y) AS m FROM ({LONG}) GROUP BY t) SELECT CAST({VOLUMES} AS BIGINT) AS n, round(sum((y - m) * (y - m)) / count(DISTINCT voxel_id) / {VOLUMES}, 6) + 0.0 AS mean_eigenvalue, false AS any_negative FROM ({LONG}) l JOIN m ON m.t = l.t")
def a25_eigen_stats(spark, d):
    """Statistics of all eigenvalues of the signals' covariance: their mean is the trace's share, and none is negative."""
    values = fpca.FpcaModel.fit(tab.signals(spark, d), VOLUMES, column="y").values
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    return rows.agg(F.count("v").alias("n"), r6(F.avg("v"), "mean_eigenvalue"), F.bool_or(F.col("v") <= -1e-6).alias("any_negative"))


@query(f"SELECT round(quantile_cont(abs(y), 0.95), 6) + 0.0 AS p95 FROM ({LONG})")
def a29_percentile(spark, d):
    return tab.signals(spark, d).select(F.explode("y").alias("v")).agg(r6(F.expr("percentile(abs(v), 0.95D)"), "p95"))


@query(f"SELECT voxel_id, round(v, 9) + 0.0 AS intensity FROM (SELECT voxel_id, avg(abs(y)) AS v FROM ({LONG}) GROUP BY voxel_id) ORDER BY round(v, 9) DESC, voxel_id LIMIT 20")
def a11_top_intensity(spark, d):
    s = tab.signals(spark, d).select("voxel_id", r6(F.aggregate("y", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size("y"), "intensity", 9))
    return R.top_k(s, 20, F.desc("intensity"), F.col("voxel_id"))


# --- stimulus, lag search, combination -----------------------------------------------------------------------------

_REG = "SELECT unnest(range({n})) AS t, unnest([{r}]) AS g".format(n=VOLUMES, r=", ".join(f"CAST({x} AS DOUBLE)" for x in regressor()))


@query(f"SELECT voxel_id, round(abs(corr(y, g)), 6) + 0.0 AS abs_r FROM ({LONG}) l JOIN ({_REG}) r ON r.t = l.t GROUP BY voxel_id")
def t6_stimulus_correlation(spark, d):
    return T.stimulus_correlation(tab.signals(spark, d), regressor()).select("voxel_id", r6("abs_r", "abs_r"))


@query(f"""WITH c AS (SELECT unnest(range(-3, 4)) AS lag), p AS (SELECT lag, dur FROM c CROSS JOIN (SELECT unnest([1, 3, 5]) AS dur)),
 r AS (SELECT lag, dur, user_id, abs(corr(y, CASE WHEN t BETWEEN 10 + lag AND 10 + lag + dur THEN 1.0 ELSE 0.0 END)) AS r FROM ({EV}) CROSS JOIN p GROUP BY ALL)
 SELECT CAST(lag AS DOUBLE) AS lag, CAST(dur AS DOUBLE) AS duration, round(avg(CASE WHEN isnan(r) THEN NULL ELSE r END), 6) + 0.0 AS mean_abs_r FROM r GROUP BY lag, dur""")
def t7_lag_grid(spark, d):
    """Mean absolute correlation of the subjects' days with a boxcar after day 10, for each lag and duration."""
    grid = T.lag_grid(tab.subject_days(spark, d), 10.0, [float(x) for x in range(-3, 4)], [1.0, 3.0, 5.0])
    return grid.select("lag", "duration", r6("mean_abs_r", "mean_abs_r"))


@query()
def t8_best_lag(spark, d):
    """The whole search: coarse lag, coarse duration, then hill-climbing."""
    lag, duration, r = T.search_lag(tab.subject_days(spark, d), 10.0, [float(x) for x in range(-3, 4)], [1.0, 3.0, 5.0])
    return spark.createDataFrame([(lag, duration, r)], "lag double, duration double, mean_abs_r double")


@query()
def t8_lag_by_component(spark, d):
    """The search for each region's series (a component) in each half of the volumes (a movement), after the fifth sample."""
    y = _roi_arrays(spark, d)
    halves = F.array(F.struct(F.lit(1).alias("movement"), F.slice("y", 1, VOLUMES // 2).alias("y")), F.struct(F.lit(2).alias("movement"), F.slice("y", VOLUMES // 2 + 1, VOLUMES // 2).alias("y")))
    parts = y.select(F.col("roi").alias("pc"), F.explode(halves).alias("h")).select("pc", "h.movement", "h.y")
    found = T.search_lags(parts, 5.0, [float(x) for x in range(0, 10)], [1.0, 3.0, 5.0])
    return found.select("pc", "movement", "lag", "duration", r6("abs_r", "abs_r"))


_TARGET = [float(np.sin(2 * np.pi * t / 30)) for t in range(30)]


@query("""WITH r AS (SELECT user_id, corr(y, g) AS r FROM ({ev}) e JOIN (SELECT unnest(range(30)) AS t, unnest([{g}]) AS g) x ON x.t = e.t GROUP BY user_id)
 SELECT CAST(e.t AS BIGINT) AS t, round(sum(sign(r) * y), 4) + 0.0 AS combined FROM ({ev}) e JOIN r ON r.user_id = e.user_id WHERE abs(r) > 0.1 AND e.user_id <> 0 GROUP BY e.t""".format(ev=EV, g=", ".join(f"CAST({v!r} AS DOUBLE)" for v in _TARGET)))
def t9_combine_signals(spark, d):
    """Subjects as components: the signed sum of those that follow a sine; subject 0 plays the component that never counts."""
    s = tab.subject_days(spark, d).withColumnRenamed("user_id", "pc")
    return T.combine(s, _TARGET).select(F.col("t").cast("long").alias("t"), r6("combined", "combined", 4))


@query(f"SELECT voxel_id, t, round(c.v * b.v, 6) + 0.0 AS y FROM (SELECT voxel_id, list_avg(y) AS v FROM ({SIG})) c CROSS JOIN (SELECT unnest(range(8)) AS t, unnest([{', '.join(f'CAST({float(np.cos(k))!r} AS DOUBLE)' for k in range(8))}]) AS v) b")
def f11_outer_product(spark, d):
    """A voxel weight (its mean) times a short temporal profile, as rows."""
    profile = F.array(*[F.lit(float(np.cos(k))) for k in range(8)])
    s = tab.signals(spark, d).select("voxel_id", C.mean_of("y").alias("w"), F.posexplode(profile).alias("t", "v"))
    return s.select("voxel_id", F.col("t").cast("long").alias("t"), r6(F.col("w") * F.col("v"), "y"))


@query(f"SELECT subject, CAST(count(*) AS INTEGER) AS n, round(sum(n * y), 6) + 0.0 AS moment FROM (SELECT voxel_id // 2 AS subject, y, row_number() OVER (PARTITION BY voxel_id // 2 ORDER BY voxel_id, t) AS n FROM ({LONG})) GROUP BY subject")
def u1_concat_movements(spark, d):
    """Even and odd voxels as two movements of a subject, one after the other; the moment depends on the order."""
    s = tab.signals(spark, d).select(F.floor(F.col("voxel_id") / 2).alias("subject"), (F.col("voxel_id") % 2).alias("movement"), "y")
    both = R.concatenated(s, ["subject"], "movement", "y")
    moment = F.aggregate(F.transform("y", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return both.select("subject", F.size("y").alias("n"), r6(moment, "moment"))


@query(f"SELECT voxel_id, flipped, round(list_sum(list_transform(y[5:60], lambda x: CASE WHEN flipped THEN -x ELSE x END)), 6) + 0.0 AS total FROM ({SIG}) CROSS JOIN (SELECT unnest([true, false]) AS flipped)")
def u2_reversed_stack(spark, d):
    """Each series and its reverse in sign, with the edges trimmed."""
    s = tab.signals(spark, d).select("voxel_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("flipped"), C.crop("y", 4, 4).alias("y"))
    y = C.reverse_sign("y", F.col("flipped"))
    return s.select("voxel_id", "flipped", r6(F.aggregate(y, F.lit(0.0), lambda a, x: a + x), "total"))


# --- the spline basis at the events' hours ------------------------------------------------------------------------------

_HOUR = "(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 3600.0"


_BASIS = f"SELECT event_id, unnest(range({K})) AS k, unnest(b) AS v FROM ({Q.basis(f'SELECT event_id, {_HOUR} AS x FROM events', 0.0, 24.0, K, DEGREE, keep='event_id')})"


def _event_basis(spark, d):
    """event_id, b: the values of all basis functions at the event's hour of the day."""
    hour = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 3600.0
    events = tab.table(spark, d, "events").select("event_id", F.array(hour).alias("hour"))
    knot = knots(0.0, 24.0, K, DEGREE)
    return fpca.map_series(events, "hour", "b array<double>", lambda x: (fpca.as_lists(evaluate(x[:, 0], knot, DEGREE)),))


@query(f"SELECT event_id, CAST(k AS BIGINT) AS k, round(v, 9) + 0.0 AS value FROM ({_BASIS}) WHERE round(v, 9) > 0")
def n1_basis_matrix(spark, d):
    """The basis functions that are not zero at each event's hour."""
    rows = _event_basis(spark, d).select("event_id", F.posexplode("b").alias("k", "v"))
    return rows.select("event_id", F.col("k").cast("long").alias("k"), r6("v", "value", 9)).filter("value > 0")


@query(f"SELECT event_id, round(sum(v), 9) + 0.0 AS total FROM ({_BASIS}) GROUP BY event_id")
def n1_partition_of_unity(spark, d):
    return _event_basis(spark, d).select("event_id", r6(F.aggregate("b", F.lit(0.0), lambda a, v: a + v), "total", 9))


@query(f"SELECT a.k AS i, b.k AS j, round(sum(a.v * b.v), 4) + 0.0 AS g FROM ({_BASIS}) a JOIN ({_BASIS}) b ON a.event_id = b.event_id GROUP BY ALL")
def a4_gram_basis(spark, d):
    """The Gram matrix of the basis over all events' hours."""
    _, _, gram = fpca.moments(_event_basis(spark, d), "b")
    rows = [(i, j, float(gram[i, j])) for i in range(K) for j in range(K)]
    return spark.createDataFrame(rows, "i long, j long, v double").select("i", "j", r6("v", "g", 4))


@query(f"SELECT event_id, CASE WHEN dayofmonth(ts) - 1 + {_HOUR} / 24 BETWEEN 12 AND 15.5 OR dayofmonth(ts) - 1 + {_HOUR} / 24 BETWEEN 20 AND 21 THEN 1 ELSE 0 END AS reg FROM events")
def t5_boxcar(spark, d):
    """Whether each event lies in one of two boxcars (day 10 with lag 2 and duration 3.5; day 20 with duration 1)."""
    hour = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 3600.0
    t = F.dayofmonth("ts") - 1 + hour / 24
    inside = (T.boxcar(t, 12.0, 3.5) == 1) | (T.boxcar(t, 20.0, 1.0) == 1)
    return tab.table(spark, d, "events").select("event_id", F.when(inside, 1).otherwise(0).alias("reg"))


# --- similarity and peaks -------------------------------------------------------------------------------------------

_ROI_SERIES = f"SELECT roi, t, avg(y) AS y FROM ({LONG}) GROUP BY ALL"


def _roi_series(spark, d):
    return tab.to_long(tab.signals(spark, d)).groupBy("roi", "t").agg(F.avg("y").alias("y"))


@query(f"SELECT roi, CAST(t AS BIGINT) AS t, round(y, 6) + 0.0 AS height, CASE WHEN y > p AND y > n THEN 1 ELSE -1 END AS kind FROM (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS n FROM ({_ROI_SERIES}) WINDOW w AS (PARTITION BY roi ORDER BY t)) WHERE (y > p AND y > n) OR (y < p AND y < n)")
def w4_raw_peaks(spark, d):
    return T.raw_peaks(_roi_series(spark, d), ["roi"]).select("roi", F.col("t").cast("long").alias("t"), r6("y", "height"), "kind")


@query(f"SELECT roi, CAST(t AS BIGINT) AS t, round(CASE WHEN (y > p AND y > n) OR (y < p AND y < n) THEN y ELSE 0 END, 6) + 0.0 AS peak FROM (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS n FROM ({_ROI_SERIES}) WINDOW w AS (PARTITION BY roi ORDER BY t))")
def f13_peak_signal(spark, d):
    return T.peak_signal(_roi_series(spark, d), ["roi"]).select("roi", F.col("t").cast("long").alias("t"), r6("peak", "peak"))


def _roi_arrays(spark, d):
    s = _roi_series(spark, d).groupBy("roi").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("m"))
    return s.select("roi", F.col("m.y").alias("y"))


@query(f"SELECT i, j, round(abs(r), 6) + 0.0 AS score FROM (SELECT a.roi AS i, b.roi AS j, corr(a.y, b.y) AS r FROM ({_ROI_SERIES}) a JOIN ({_ROI_SERIES}) b ON a.t = b.t AND a.roi < b.roi GROUP BY ALL) ORDER BY round(abs(r), 6) DESC, i, j LIMIT 10")
def o4_best_scores(spark, d):
    """The ten pairs of region series with the largest absolute correlation."""
    pairs = S.all_pairs(_roi_arrays(spark, d), "roi", "y").select("i", "j", r6(F.abs(C.pearson(F.col("a"), F.col("b"))), "score"))
    return R.top_k(pairs, 10, F.desc("score"), F.col("i"), F.col("j"))


_ROI_PAIRS = f"SELECT a.roi AS i, b.roi AS j, a.y AS a, b.y AS b FROM (SELECT roi, list(y ORDER BY t) AS y FROM ({_ROI_SERIES}) GROUP BY roi) a JOIN (SELECT roi, list(y ORDER BY t) AS y FROM ({_ROI_SERIES}) GROUP BY roi) b ON a.roi < b.roi"


@query(f"WITH RECURSIVE {Q.warping(_ROI_PAIRS, VOLUMES)} SELECT i, j, round(1 / (1 + distance), 6) + 0.0 AS sim FROM dtw")
def r3_dtw_similarity(spark, d):
    return S.dtw_pairs(S.all_pairs(_roi_arrays(spark, d), "roi", "y")).select("i", "j", r6("sim", "sim"))


@query(f"""WITH same AS (WITH RECURSIVE {Q.warping(_ROI_PAIRS, VOLUMES)} SELECT * FROM dtw), turned AS (WITH RECURSIVE {Q.warping(f"SELECT i, j, [-v FOR v IN a] AS a, b FROM ({_ROI_PAIRS})", VOLUMES)} SELECT * FROM dtw)
 SELECT s.i, s.j, round(least(s.distance, t.distance), 6) + 0.0 AS distance, t.distance < s.distance AS flipped FROM same s JOIN turned t ON s.i = t.i AND s.j = t.j""")
def r4_oriented_dtw(spark, d):
    return S.dtw_pairs(S.all_pairs(_roi_arrays(spark, d), "roi", "y"), oriented=True).select("i", "j", r6("distance", "distance"), "flipped")


@query(f"""WITH s AS ({_ROI_SERIES}), c AS (SELECT a.roi % 2 AS file, a.roi AS pc, b.roi % 2 AS other, b.roi AS other_pc, corr(a.y, b.y) AS r FROM s a JOIN s b ON a.t = b.t AND a.roi % 2 <> b.roi % 2 GROUP BY ALL),
 t AS (SELECT file, pc, sum(m) AS total FROM (SELECT file, pc, other, max(r * r) AS m FROM c GROUP BY ALL) GROUP BY ALL)
 SELECT file, pc AS rep_pc, round(total, 6) + 0.0 AS total FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(total, 9) DESC, pc) AS n FROM t) WHERE n = 1""")
def r2_representative_pc(spark, d):
    """Region series as components of two files (by parity): the one that the other file follows best."""
    s = _roi_arrays(spark, d)
    a, b = s.select(F.col("roi").alias("pc"), F.col("y").alias("a")), s.select(F.col("roi").alias("other_pc"), F.col("y").alias("b"))
    corr = a.join(b, F.col("pc") % 2 != F.col("other_pc") % 2).select((F.col("pc") % 2).alias("file"), "pc", (F.col("other_pc") % 2).alias("other"), "other_pc", C.pearson(F.col("a"), F.col("b")).alias("r"))
    return S.representatives(corr).select("file", "rep_pc", r6("total", "total"))


@query(f"""WITH RECURSIVE cov AS MATERIALIZED ({Q.covariance(f"SELECT roi AS k, y AS x FROM ({SIG})", VOLUMES)}), {Q.leading("SELECT k, s FROM cov", VOLUMES, 3)},
 e AS (SELECT k, v FROM e1 UNION ALL SELECT k, v FROM e2 UNION ALL SELECT k, v FROM e3)
 SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(sum(pow(list_dot_product(a.v, b.v), 2)) / 3, 6) + 0.0 AS sim FROM e a JOIN e b ON a.k < b.k GROUP BY a.k, b.k""")
def r1_subspace_similarity(spark, d):
    """Similarity of the leading subspaces of the regions' signals, for pairs of regions."""
    found = fpca.grouped_moments(tab.signals(spark, d), "roi", "y")  # regions are few by definition
    vectors = {roi: fpca.FpcaModel.of_moments(*m, 3).vectors for roi, m in sorted(found.items())}
    rows = [(i, j, S.subspace_similarity(vectors[i], vectors[j])) for i in vectors for j in vectors if i < j]
    return spark.createDataFrame(rows, "i int, j int, sim double").select("i", "j", r6("sim", "sim"))


def _region_components(spark, d):
    """Three components of each region (a subject) in each half of the volumes (a movement), with two basis sizes."""
    half, rows = VOLUMES // 2, []
    for k in (8, K):
        smoother = fpca.smoother_for(half, k, DEGREE, 2, TR)
        for movement in (1, 2):
            s = tab.signals(spark, d).select("roi", F.slice("y", (movement - 1) * half + 1, half).alias("y"))
            coeffs = fpca.fit_series(s, smoother, np.array(FEW_LAMBDAS)).select("roi", "c")
            for roi, m in fpca.grouped_moments(coeffs, "roi", "c").items():  # regions are few by definition
                model = fpca.FpcaModel.of_moments(*m, 3, penalty(0.0, (half - 1) * TR, k, DEGREE, 0), smoother.f)
                rows += [(f"K={k}", movement, roi, pc, model.vectors[:, pc].tolist(), (smoother.f @ model.vectors[:, pc]).tolist()) for pc in range(3)]
    return spark.createDataFrame(rows, "params string, movement int, subject long, pc int, vec array<double>, signal array<double>")


@query()
def r13_compare_components(spark, d):
    """Consistency over the halves of the regions' components for two basis sizes, by subspaces and by representatives."""
    components = _region_components(spark, d)
    scored = [compare.compare(components, how)[1].withColumn("how", F.lit(how)) for how in ("subspace", "fixed", "correlated")]
    out = scored[0].unionByName(scored[1]).unionByName(scored[2])
    return out.select("how", "params", r6("score", "score"), r6("one_minus_p", "one_minus_p"))


@query(f"""WITH h AS (SELECT a.user_id, a.t, a.y AS a, b.y AS b FROM ({EV}) a JOIN ({EV}) b ON a.user_id = b.user_id AND b.t = a.t + 15 WHERE a.t < 15),
 r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY a) + (count(*) OVER (PARTITION BY user_id, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY user_id ORDER BY b) + (count(*) OVER (PARTITION BY user_id, b) - 1) / 2.0 AS rb FROM h)
 SELECT round(avg(CASE WHEN isnan(rho) THEN NULL ELSE rho END), 6) + 0.0 AS mean_spearman FROM (SELECT user_id, corr(ra, rb) AS rho FROM r GROUP BY user_id)""")
def r6_consistency(spark, d):
    """Rank correlation of the two halves of each subject's month, averaged."""
    s = tab.subject_days(spark, d)
    halves = s.select("user_id", F.posexplode(F.arrays_zip(F.slice("y", 1, 15).alias("a"), F.slice("y", 16, 15).alias("b"))).alias("t", "h")).select("user_id", "t", "h.a", "h.b")
    rho = S.spearman(halves, "a", "b", ["user_id"])
    return rho.agg(r6(F.avg(F.nanvl("rho", F.lit(None).cast("double"))), "mean_spearman"))


# --- metadata, labels, joins ----------------------------------------------------------------------------------------


@query(f"SELECT sub_id, 'instrument_group: ' || instrument_group || ' | grp: ' || grp AS category FROM ({MD})")
def p6_category(spark, d):
    m = tab.metadata(spark, d).withColumnRenamed("group", "grp")
    return m.select("sub_id", C.joined_category(["instrument_group", "grp"]).alias("category"))


@query(f"WITH k AS (SELECT sub_id, instrument_group AS category FROM ({MD}) WHERE lower(trim(instrument_group)) NOT IN ('', 'nan', 'none', 'furniture')) SELECT sub_id, category FROM k WHERE (SELECT count(DISTINCT category) FROM k) >= 2 AND (SELECT count(*) FROM k) >= 5")
def p7_valid_targets(spark, d):
    """Known categories only; one segment stands for missing data."""
    target = F.when(F.col("instrument_group") != "FURNITURE", F.col("instrument_group"))
    return R.valid_targets(tab.metadata(spark, d), target, "sub_id")


@query("SELECT event_id, lower(trim(CASE WHEN value > 50 THEN ' Yes' WHEN value > 20 THEN 'T' ELSE 'off' END)) IN ('1', '1.0', 'true', 'yes', 't', 'y') AS positive FROM events")
def p8_positive_trait(spark, d):
    e = tab.table(spark, d, "events")
    flag = F.when(F.col("value") > 50, " Yes").when(F.col("value") > 20, "T").otherwise("off")
    return e.select("event_id", C.positive_trait(flag).alias("positive"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT regexp_matches(c_name, '(13|77|999)')")
def p9_skip_list(spark, d):
    """Names that hold none of the skipped ids."""
    return tab.table(spark, d, "customer").filter(~F.col("c_name").rlike("13|77|999")).select("c_custkey", "c_name")


@query()
def p10_random_subset(spark, d):
    """A sampling operator: 50 subjects drawn by a seeded hash, whatever the partitions."""
    return tab.metadata(spark, d).orderBy(F.xxhash64("sub_id", F.lit(42)), "sub_id").limit(50).select("sub_id")


@query(f"SELECT * FROM (SELECT sub_id, CASE WHEN is_train_set = 1 THEN CASE instrument_group WHEN '{PAIR[0]}' THEN 0 WHEN '{PAIR[1]}' THEN 1 END END AS y FROM ({MD})) WHERE y IS NOT NULL")
def p4_binary_label(spark, d):
    m = tab.metadata(spark, d)
    return m.select("sub_id", C.train_label(F.col("instrument_group"), *PAIR, F.col("is_train_set") == 1).alias("y")).filter("y IS NOT NULL")


@query(f"SELECT y, count(*) AS n FROM (SELECT CASE instrument_group WHEN '{PAIR[0]}' THEN 0 WHEN '{PAIR[1]}' THEN 1 END AS y FROM ({MD}) WHERE is_train_set = 0) WHERE y IS NOT NULL GROUP BY y")
def p5_test_class_counts(spark, d):
    m = tab.metadata(spark, d)
    y = C.train_label(F.col("instrument_group"), *PAIR, F.col("is_train_set") == 0).alias("y")
    return m.select(y).filter("y IS NOT NULL").groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("WITH g AS (SELECT DISTINCT c_mktsegment AS g FROM customer UNION SELECT 'NM' UNION SELECT 'mus') SELECT a.g AS group_0, b.g AS group_1 FROM g a JOIN g b ON a.g < b.g WHERE NOT ('mus' IN (a.g, b.g)) OR 'NM' IN (a.g, b.g)")
def p11_valid_pairs(spark, d):
    extra = spark.createDataFrame([("NM",), ("mus",)], "group string")
    return R.valid_pairs(tab.table(spark, d, "customer").select(F.col("c_mktsegment").alias("group")).distinct().unionByName(extra))


@query(f"SELECT sub_id, grp, round(avg(y), 6) + 0.0 AS mean_value FROM ({EV}) e JOIN ({MD}) m ON m.sub_id = e.user_id GROUP BY ALL")
def j1_train_rows(spark, d):
    """Subjects' series with their metadata."""
    s = tab.subject_days(spark, d).select(F.col("user_id").alias("sub_id"), (F.aggregate("y", F.lit(0.0), lambda a, x: a + x) / F.size("y")).alias("m"))
    return s.join(tab.metadata(spark, d), "sub_id").select("sub_id", F.col("group").alias("grp"), r6("m", "mean_value"))


@query(f"SELECT e.user_id, m.instrument_group FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN ({MD}) m ON m.sub_id = e.user_id AND m.is_train_set = 1")
def j3_left_metadata(spark, d):
    m = tab.metadata(spark, d).filter("is_train_set = 1").select(F.col("sub_id").alias("user_id"), "instrument_group")
    return tab.table(spark, d, "events").select("user_id").distinct().join(m, "user_id", "left")


@query(f"SELECT sub_id FROM ({MD}) WHERE sub_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def j8_missing_ids(spark, d):
    e = tab.table(spark, d, "events").select(F.col("user_id").alias("sub_id"))
    return tab.metadata(spark, d).select("sub_id").join(e, "sub_id", "left_anti")


@query("SELECT user_id FROM events WHERE dayofmonth(ts) <= 15 INTERSECT SELECT user_id FROM events WHERE dayofmonth(ts) > 15")
def j7_both_movements(spark, d):
    """Subjects with events in both halves of a month."""
    e = tab.table(spark, d, "events")
    early, late = F.bool_or(F.dayofmonth("ts") <= 15), F.bool_or(F.dayofmonth("ts") > 15)
    return e.groupBy("user_id").agg(early.alias("a"), late.alias("b")).filter("a AND b").select("user_id")


@query("SELECT user_id, CAST(count(DISTINCT CASE WHEN dayofmonth(ts) <= 15 THEN 1 ELSE 2 END) AS BIGINT) AS movements FROM events WHERE regexp_matches(event_type, '^(view|click)$') GROUP BY user_id HAVING count(DISTINCT CASE WHEN dayofmonth(ts) <= 15 THEN 1 ELSE 2 END) = 2")
def s3_paired_movements(spark, d):
    e = tab.table(spark, d, "events").filter(F.col("event_type").rlike("^(view|click)$"))
    movement = F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2)
    return e.groupBy("user_id").agg(F.count_distinct(movement).alias("movements")).filter("movements = 2")


@query(f"SELECT voxel_id, roi, x.name FROM ({SIG}) s JOIN (SELECT unnest(range(10)) AS r, unnest(['roi_' || x FOR x IN range(10)]) AS name) x ON x.r = s.roi")
def j12_voxel_atlas(spark, d):
    """Voxels with their region's name from an atlas table."""
    atlas = spark.range(10).select(F.col("id").cast("int").alias("roi"), F.concat(F.lit("roi_"), "id").alias("name"))
    return tab.signals(spark, d).join(F.broadcast(atlas), "roi").select("voxel_id", "roi", "name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem) WHERE n = 1")
def u3_first_rows(spark, d):
    """One row for each repeated key, the first in an explicit order."""
    li = tab.table(spark, d, "lineitem")
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).alias("m")
    return li.groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "m.l_partkey")


# --- features --------------------------------------------------------------------------------------------------------


def _window_sql() -> str:
    blocks = []
    for e, lo in ((1, 0), (2, 14)):
        part = f"list_filter(l, lambda x, k: k > {lo} AND k <= {lo + 14})"
        blocks.append(f"SELECT subject, {e} AS experiment, roi, 0 AS block, list_stddev_pop({part}) AS v FROM a UNION ALL SELECT subject, {e}, roi, 1, list_avg(list_transform({part}, lambda x: abs(x))) FROM a")
        at = lo
        for w in range(6):
            size = 14 // 6 + (w < 14 % 6)
            blocks.append(f"SELECT subject, {e}, roi, {w + 2}, list_avg(l[{at + 1}:{at + size}]) FROM a")
            at += size
    return f"WITH a AS (SELECT subject, roi, list(y ORDER BY t) AS l FROM ({RS}) GROUP BY ALL) SELECT subject, CAST(experiment AS INTEGER) AS experiment, roi, CAST(block AS INTEGER) AS block, round(v, 4) + 0.0 AS value FROM (" + " UNION ALL ".join(blocks) + ")"


@query(_window_sql())
def a9_window_features(spark, d):
    f = R.window_features(tab.region_series(spark, d), ["subject", "roi"], tab.QUARTERS, tab.HALF)
    return f.select("subject", "experiment", "roi", "block", r6("value", "value", 4))


def _event_sql() -> str:
    n, parts = 30, ["SELECT user_id, roi, 0 AS block, list_avg(l) AS v FROM a", "SELECT user_id, roi, 1, list_stddev_pop(l) FROM a"]
    for k, (s, e) in enumerate(SEGMENTS):
        lo, hi = min(s + 6, n), min(e + 6, n)
        parts.append(f"SELECT user_id, roi, {2 + k}, " + (f"list_avg(l[{lo + 1}:{hi}])" if hi - lo >= 3 else "list_avg(l)") + " FROM a")
    for k, tr in enumerate(TRANSITIONS):
        value = f"list_avg(l[{tr + 1}:{min(tr + 11, n)}]) - list_avg(l[{tr - 4}:{tr}])" if 5 <= tr < n - 5 else "0.0"
        parts.append(f"SELECT user_id, roi, {2 + len(SEGMENTS) + k}, {value} FROM a")
    return f"WITH a AS (SELECT user_id, roi, list(y ORDER BY t) AS l FROM ({EVR}) GROUP BY ALL) SELECT user_id, roi, CAST(block AS INTEGER) AS block, round(v, 6) + 0.0 AS value FROM (" + " UNION ALL ".join(parts) + ")"


@query(_event_sql())
def a10_event_features(spark, d):
    f = R.event_features(tab.subject_regions(spark, d), ["user_id", "roi"], tab.DAYS, list(SEGMENTS), list(TRANSITIONS))
    return f.select("user_id", "roi", "block", r6("value", "value"))


@query(f"SELECT a.user_id, a.roi AS roi_i, b.roi AS roi_j, round(CASE WHEN isnan(corr(a.y, b.y)) THEN NULL ELSE corr(a.y, b.y) END, 6) + 0.0 AS r FROM ({EVR}) a JOIN ({EVR}) b ON a.user_id = b.user_id AND a.t = b.t AND a.roi < b.roi GROUP BY ALL")
def a10_connectivity(spark, d):
    """Correlations of the regions that a subject has."""
    f = R.connectivity(tab.subject_regions(spark, d), "user_id", ["click", "error", "purchase", "signup", "view"])
    return f.filter("present").select("user_id", "roi_i", "roi_j", r6("r", "r"))


@query(f"SELECT subject, CAST(t * 6 + r.k AS BIGINT) AS feature, round(y, 4) + 0.0 AS x FROM ({RS}) s JOIN (SELECT unnest(['AF','AO','NF','NO','RF','RO']) AS roi, unnest(range(6)) AS k) r ON r.roi = s.roi")
def f7_flatten(spark, d):
    """Region series as one vector a subject, volume by volume."""
    x = R.flattened(tab.region_series(spark, d), ["subject"], list(tab.REGIONS), tab.QUARTERS)
    return x.select("subject", F.posexplode("x").alias("k", "v")).select("subject", F.col("k").cast("long").alias("feature"), r6("v", "x", 4))


@query(f"SELECT CAST(t * 6 + r.k AS BIGINT) AS feature, CAST(r.k AS BIGINT) AS roi, CASE WHEN t < 14 THEN 1 ELSE 2 END AS experiment, CAST(t % 14 AS BIGINT) AS block, round(avg(y), 4) + 0.0 AS mean_value FROM ({RS}) s JOIN (SELECT unnest(['AF','AO','NF','NO','RF','RO']) AS roi, unnest(range(6)) AS k) r ON r.roi = s.roi GROUP BY t, r.k")
def f8_feature_layout(spark, d):
    """Where each feature of the flattened vectors comes from, with its mean over subjects."""
    x = R.flattened(tab.region_series(spark, d), ["subject"], list(tab.REGIONS), tab.QUARTERS)
    kind = R.infer_layout(len(tab.REGIONS) * tab.QUARTERS, len(tab.REGIONS), tab.QUARTERS)
    means = x.select(F.posexplode("x").alias("feature", "v")).groupBy(F.col("feature").cast("long").alias("feature")).agg(F.avg("v").alias("m"))
    return means.select("feature", *R.layout_columns(F.col("feature"), len(tab.REGIONS), tab.HALF, kind), r6("m", "mean_value", 4))


_FEATURES = f"SELECT CAST(t AS BIGINT) AS feature, roi AS label, y AS value FROM ({LONG})"


def _features(spark, d):
    s = tab.to_long(tab.signals(spark, d))
    return s.select(F.col("t").cast("long").alias("feature"), F.col("roi").alias("label"), F.col("y").alias("value"))


_ANOVA = f"""WITH g AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM ({_FEATURES}) GROUP BY ALL), s AS (SELECT feature, sum(n) AS total, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS w, sum(n * m * m) AS q FROM g GROUP BY feature)
 SELECT feature, ((q - total * mean * mean) / (k - 1)) / (w / (total - k)) AS f FROM s"""


@query(f"SELECT feature, f_stat, rank FROM (SELECT feature, round(f, 6) + 0.0 AS f_stat, row_number() OVER (ORDER BY round(f, 6) DESC, feature) AS rank FROM ({_ANOVA})) WHERE rank <= 10")
def m6_anova_f_topk(spark, d):
    f = R.anova_f(_features(spark, d)).select("feature", r6("f_stat", "f_stat"))
    top = R.top_k(f, 10, F.desc("f_stat"), F.col("feature"))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f_stat"), "feature")).cast("long"))


@query(f"SELECT voxel_id, t, round(CASE WHEN sd > 0 THEN (y - m) / sd ELSE 0 END, 6) + 0.0 AS z FROM (SELECT voxel_id, CAST(t AS BIGINT) AS t, y, avg(y) OVER (PARTITION BY t) AS m, stddev_pop(y) OVER (PARTITION BY t) AS sd FROM ({LONG}))")
def m7_standardise(spark, d):
    s = tab.to_long(tab.signals(spark, d)).select("voxel_id", F.col("t").cast("long").alias("t"), "y")
    return R.standardised(s, "t", "y").select("voxel_id", "t", r6("z", "z"))


# --- representational similarity -------------------------------------------------------------------------------------

_SUBJ = f"SELECT user_id, y, avg(y) OVER (PARTITION BY user_id) AS m, t FROM ({EV})"
_DIST = f"SELECT a.user_id AS i, b.user_id AS j, 1 - corr(a.y, b.y) AS d FROM ({EV}) a JOIN ({EV}) b ON a.t = b.t AND a.user_id < b.user_id GROUP BY ALL"


@query(f"SELECT i, j, round(d, 6) + 0.0 AS d FROM ({_DIST})")
def r7_correlation_distance(spark, d):
    return rsa.correlation_distance(tab.subject_days(spark, d), "user_id", "y", 6)


_LABELS = "SELECT DISTINCT user_id AS id, CAST(user_id % 4 AS BIGINT) AS label FROM events"


def _labels(spark, d):
    return tab.table(spark, d, "events").select(F.col("user_id").alias("id"), (F.col("user_id") % 4).alias("label")).distinct()


_GROUP_DIST = f"SELECT least(a.label, b.label) AS label_i, greatest(a.label, b.label) AS label_j, avg(d) AS d FROM ({_DIST}) JOIN ({_LABELS}) a ON a.id = i JOIN ({_LABELS}) b ON b.id = j GROUP BY ALL"


@query(f"SELECT label_i, label_j, round(d, 6) + 0.0 AS d FROM ({_GROUP_DIST}) UNION ALL SELECT label, label, 0.0 FROM (SELECT label FROM ({_LABELS}) GROUP BY label HAVING count(*) = 1)")
def a12_group_distance(spark, d):
    g = rsa.group_distances(tab.subject_days(spark, d), _labels(spark, d), "user_id", "y")
    return g.select("label_i", "label_j", r6("d", "d"))


@query(f"""WITH p AS (SELECT d, CASE WHEN a.label <> b.label THEN 1.0 ELSE 0.0 END AS m FROM (SELECT i, j, round(d, 9) AS d FROM ({_DIST})) JOIN ({_LABELS}) a ON a.id = i JOIN ({_LABELS}) b ON b.id = j),
 r AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS a, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS b FROM p) SELECT round(corr(a, b), 6) + 0.0 AS rho FROM r""")
def r8_rsa_rho(spark, d):
    """Rank correlation of the distances with "labels differ", before any permutation."""
    return rsa.rank_correlation(tab.subject_days(spark, d), _labels(spark, d), "user_id", "y").select(r6("rho", "rho"))


_SPREAD = f"SELECT user_id AS id, CAST(user_id % 4 AS VARCHAR) AS label FROM ({EV}) GROUP BY user_id HAVING var_pop(y) > 0"
_SPREAD_DIST = f"SELECT i, j, round(d, 9) AS d FROM ({_DIST}) WHERE i IN (SELECT id FROM ({_SPREAD})) AND j IN (SELECT id FROM ({_SPREAD}))"


@query(G.rank_test(_SPREAD_DIST, _SPREAD, 1000, 11))
def r8_rsa_permutation(spark, d):
    """The rank correlation and its p among 1000 shuffles of the labels."""
    days = tab.subject_days(spark, d).select("user_id", F.col("y").alias("x"))
    return rsa.rank_permutation(days, _labels(spark, d), "user_id", 1000, 11).select(r6("rho", "rho"), "p")


@query(f"""WITH RECURSIVE {G.group_tests(_SPREAD_DIST.replace("round(d, 9)", "d"), _SPREAD, 1000, 7)},
 raw AS (SELECT 'parity' AS target, a || ' vs ' || b AS pair, distance, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, a || ' vs ' || b) AS raw FROM tested)
 SELECT target, pair, round(distance, 6) + 0.0 AS distance, round(p, 6) + 0.0 AS rsa_p, round(least(min(raw) OVER (ORDER BY p, pair ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) + 0.0 AS rsa_q FROM raw""")
def r9_r10_rsa_tests(spark, d):
    """Separation and cohesion tests with seeded permutations, and their false-discovery rates."""
    s = tab.subject_days(spark, d).select("user_id", F.col("y").alias("x"))
    out = rsa.analyse(spark, s, "user_id", _labels(spark, d).withColumn("label", F.col("label").cast("string")), "parity", seed=7)
    return out.select("target", "pair", r6("distance", "distance"), r6("rsa_p", "rsa_p"), r6("rsa_q", "rsa_q"))


_PVALUES = "SELECT p_brand AS name, p_type, round((sum(p_size * 37 + p_partkey * 11) % 1000 + 1) / 1001.0, 9) AS p FROM part GROUP BY ALL"


@query(f"""WITH b AS ({_PVALUES}), r AS (SELECT *, p * count(*) OVER (PARTITION BY name) / row_number() OVER (PARTITION BY name ORDER BY p, p_type) AS raw FROM b)
 SELECT name, p_type, p, round(least(min(raw) OVER (PARTITION BY name ORDER BY p, p_type ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) + 0.0 AS q FROM r""")
def w3_bh_fdr(spark, d):
    """False-discovery rates within each brand, of p-values made up from part sizes."""
    p = tab.table(spark, d, "part").groupBy(F.col("p_brand").alias("name"), "p_type").agg(F.round((F.sum(F.col("p_size") * 37 + F.col("p_partkey") * 11) % 1000 + 1) / 1001.0, 9).alias("p"))
    return R.bh_fdr(p, "p", ["p_type"], ["name"]).select("name", "p_type", "p", r6("q", "q"))


@query("SELECT user_id, CAST(max(run) AS BIGINT) AS runs FROM (SELECT user_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id")
def w5_category_runs(spark, d):
    """How many runs of one event type each subject's events make up."""
    e = tab.table(spark, d, "events")
    return R.run_starts(e, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id").agg(F.max("run").alias("runs"))


# --- classification and reports --------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT y, round(score, 9) AS score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS h FROM ({PRED})), c AS (SELECT count(*) AS n, count(*) FILTER (y = 0 AND h = 0) AS tn, count(*) FILTER (y = 0 AND h = 1) AS fp, count(*) FILTER (y = 1 AND h = 0) AS fn, count(*) FILTER (y = 1 AND h = 1) AS tp FROM p),
 r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM p), u AS (SELECT (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r)
 SELECT tn, fp, fn, tp, round((tn + tp) / n, 6) + 0.0 AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) + 0.0 AS balanced_accuracy, round(auc, 6) + 0.0 AS auc FROM c, u""")
def a27_metrics(spark, d):
    p = tab.predictions(spark, d).select("y", F.round("score", 9).alias("score"), F.when(F.col("score") > 0.5, 1).otherwise(0).alias("h"))
    return R.classification_metrics(p, "y", "h", "score").select("tn", "fp", "fn", "tp", r6("accuracy", "accuracy"), r6("balanced_accuracy", "balanced_accuracy"), r6("auc", "auc"))


def _pair_rows(spark, d):
    """Features of subjects (days) as (id, x), and labels (pair, id, y) of two pairs of parities."""
    days = tab.subject_days(spark, d).select(F.col("user_id").alias("id"), F.col("y").alias("x"))
    label = F.col("id") % 4
    pair = F.when(label < 2, "0 vs 1").otherwise("2 vs 3")
    return days, days.select(pair.alias("pair"), "id", (label % 2).cast("int").alias("y"))


@query()
def m9_nested_cv(spark, d):
    """Out-of-fold scores of logistic regression and a tree for each pair of groups."""
    tree = learning.tables_cv(*_pair_rows(spark, d), ["DTree"], k=3)
    linear = crossval.nested_cv(*_pair_rows(spark, d), "LR", [{"k": 10}, {"k": 20}], folds=3).withColumn("id", F.col("id").cast("string"))
    return linear.unionByName(tree.select(linear.columns)).select("pair", "ml_model", "id", "y", r6("cv_prob", "cv_prob"), "cv_pred")


@query()
def m13_test_evaluation(spark, d):
    """Stored models of two pairs of segments on the subjects that they were not trained on (days as features)."""
    days = tab.subject_days(spark, d).select(F.col("user_id").alias("id"), F.col("y").alias("x"))
    groups = tab.metadata(spark, d).select(F.col("sub_id").alias("id"), F.col("instrument_group").alias("group"), "is_train_set")
    root = spark.sparkContext.getConf().get("spark.sql.warehouse.dir", spark.conf.get("spark.sql.warehouse.dir"))
    root = f"{root}/pair_models_{uuid.uuid4().hex}"
    pairs, models = [PAIR, ("AUTOMOBILE", "HOUSEHOLD")], ["LR", "DTree"]
    classify.train_all(days, groups.filter("is_train_set = 1"), pairs, models, root, "first", k=10)
    found = classify.evaluate_all(days, groups.filter("is_train_set = 0"), pairs, models, root)
    classify.discard(spark, root)
    if found is None:
        return spark.createDataFrame([], "pair string, ml_model string, n long, balanced_accuracy double, auc double")
    return found.select("pair", "ml_model", "n", r6("balanced_accuracy", "balanced_accuracy"), r6("auc", "auc"))


@query()
def m10_permutation_p(spark, d):
    """p of the cross-validated accuracy of logistic regression under shuffled labels, for each pair."""
    return crossval.permutation_test(*_pair_rows(spark, d), "LR", [{"k": 10}, {"k": 20}], folds=3).select("pair", "p")


@query(f"""WITH RECURSIVE days AS MATERIALIZED (SELECT user_id, list(y ORDER BY t) AS x FROM ({EV}) GROUP BY user_id), cov AS MATERIALIZED ({Q.covariance("SELECT 0 AS k, x FROM days", tab.DAYS)}), {Q.leading("SELECT k, s FROM cov", tab.DAYS, 2)}
 SELECT user_id, """ + ", ".join(f"round(list_dot_product([x[i] - mean[i] FOR i IN range(1, {tab.DAYS + 1})], e{c}.v), 4) + 0.0 AS pc{c}" for c in (1, 2)) + " FROM days, cov, e1, e2")
def m12_principal_plane(spark, d):
    """Subjects on the two leading principal axes of their features."""
    model = fpca.FpcaModel.fit(tab.subject_days(spark, d), 2, column="y")
    scores = model.transform(tab.subject_days(spark, d), "y")
    return scores.select("user_id", r6(F.element_at("s", 1), "pc1", 4), r6(F.element_at("s", 2), "pc2", 4))


@query()
def m14_importances(spark, d):
    """Importance of each feature (a day) for each pair and model, ranked."""
    features, labels = _pair_rows(spark, d)
    found = crossval.importances(features, labels, "LR").unionByName(crossval.importances(features, labels, "SVM"))
    return R.ranked(found, ["pair", "ml_model"], "weight", "feature_idx").select("pair", "ml_model", "feature_idx", r6("weight", "weight"), "selected", "rank")


_PAIRDIST = f"SELECT split_part(pair, ' vs ', 1) AS group_a, split_part(pair, ' vs ', 2) AS group_b, avg(importance) AS distance, min(importance) AS intra_a, max(importance) AS intra_b FROM ({IMP}) GROUP BY pair"


def _pair_distances(spark, d):
    imp = tab.importances(spark, d)
    a, b = F.split_part("pair", F.lit(" vs "), F.lit(1)), F.split_part("pair", F.lit(" vs "), F.lit(2))
    return imp.groupBy(a.alias("group_a"), b.alias("group_b")).agg(F.avg("importance").alias("distance"), F.min("importance").alias("intra_a"), F.max("importance").alias("intra_b"))


@query(f"WITH d AS ({_PAIRDIST}), q AS (SELECT DISTINCT l_linestatus AS group_0, l_returnflag AS group_1 FROM lineitem), s AS (SELECT group_a AS group_0, group_b AS group_1, distance, intra_a AS intra_0, intra_b AS intra_1 FROM d UNION ALL SELECT group_b, group_a, distance, intra_b, intra_a FROM d) SELECT q.group_0, q.group_1, round(distance, 6) + 0.0 AS distance, round(intra_0, 6) + 0.0 AS intra_0, round(intra_1, 6) + 0.0 AS intra_1 FROM q LEFT JOIN s ON s.group_0 = q.group_0 AND s.group_1 = q.group_1")
def j5_symmetric_pair_join(spark, d):
    """Pairs in the other order than the distances, with the intra values turned too."""
    q = tab.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("group_0"), F.col("l_returnflag").alias("group_1")).distinct()
    return R.symmetric_lookup(q, _pair_distances(spark, d)).select("group_0", "group_1", r6("distance", "distance"), r6("intra_0", "intra_0"), r6("intra_1", "intra_1"))


@query(f"WITH d AS ({_PAIRDIST}), i AS (SELECT c_mktsegment, 1) SELECT d.group_a, d.group_b, round(distance, 6) + 0.0 AS distance, round(a.v, 6) + 0.0 AS intra_a, round(b.v, 6) + 0.0 AS intra_b FROM d LEFT JOIN (SELECT l_returnflag AS g, avg(l_tax) AS v FROM lineitem GROUP BY 1) a ON a.g = d.group_a LEFT JOIN (SELECT l_returnflag AS g, avg(l_tax) AS v FROM lineitem GROUP BY 1) b ON b.g = d.group_b".replace(", i AS (SELECT c_mktsegment, 1)", ""))
def j6_intra_lookup(spark, d):
    intra = tab.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("group")).agg(F.avg("l_tax").alias("value"))
    return R.intra_lookup(_pair_distances(spark, d).select("group_a", "group_b", "distance"), intra).select("group_a", "group_b", r6("distance", "distance"), r6("intra_a", "intra_a"), r6("intra_b", "intra_b"))


_BACC = f"SELECT pair, ml_model, max(importance) / 10 AS bacc FROM ({IMP}) GROUP BY ALL"


def _bacc(spark, d):
    return tab.importances(spark, d).groupBy("pair", "ml_model").agg((F.max("importance") / 10).alias("bacc"))


MODELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT pair, " + ", ".join(f"round(max(bacc) FILTER (ml_model = '{m}'), 6) + 0.0 AS m{k}" for k, m in enumerate(MODELS)) + f" FROM ({_BACC}) GROUP BY pair")
def a13_pivot_bacc(spark, d):
    p = _bacc(spark, d).groupBy("pair").pivot("ml_model", list(MODELS)).agg(F.max("bacc"))
    return p.select("pair", *[r6(F.col(f"`{m}`"), f"m{k}") for k, m in enumerate(MODELS)])


@query(f"SELECT ml_model, round(avg(bacc), 6) + 0.0 AS nm_mean FROM ({_BACC}) WHERE (pair LIKE 'N vs %' OR pair LIKE '% vs N') AND bacc IS NOT NULL GROUP BY ml_model")
def a14_nm_average(spark, d):
    """For each model the mean over all pairs of one group, in either order."""
    b = _bacc(spark, d).filter(F.col("pair").startswith("N vs ") | F.col("pair").endswith(" vs N"))
    return b.groupBy("ml_model").agg(r6(F.avg("bacc"), "nm_mean"))


@query(f"SELECT ml_model, round(CASE WHEN count(*) > 1 AND count(DISTINCT distance) > 1 THEN corr(distance, bacc) END, 6) + 0.0 AS r FROM (SELECT b.ml_model, b.bacc, d.distance FROM ({_BACC}) b JOIN (SELECT pair, avg(importance) AS distance FROM ({IMP}) GROUP BY pair) d ON d.pair = b.pair) GROUP BY ml_model")
def a15_corr_by_model(spark, d):
    imp = tab.importances(spark, d)
    dist = imp.groupBy("pair").agg(F.avg("importance").alias("distance"))
    j = imp.groupBy("pair", "ml_model").agg((F.max("importance") / 10).alias("bacc")).join(F.broadcast(dist), "pair")
    enough = (F.count(F.lit(1)) > 1) & (F.count_distinct("distance") > 1)
    return j.groupBy("ml_model").agg(F.when(enough, F.corr("distance", "bacc")).alias("r")).select("ml_model", r6("r", "r"))


@query(f"WITH a AS (SELECT ml_model, roi FROM ({RANKED}) WHERE pair = 'A vs F' AND rank <= 3), b AS (SELECT ml_model, roi FROM ({RANKED}) WHERE pair = 'R vs F' AND rank <= 3) SELECT m.ml_model, CAST(count(b.roi) AS INTEGER) AS overlap FROM (SELECT DISTINCT ml_model FROM a) m LEFT JOIN a ON a.ml_model = m.ml_model LEFT JOIN b ON b.ml_model = a.ml_model AND b.roi = a.roi GROUP BY m.ml_model")
def u4_top3_overlap(spark, d):
    """Regions that two pairs' three best have in common, for each model."""
    top = _ranked(spark, d).filter("rank <= 3").groupBy("ml_model", "pair").agg(F.collect_set("roi").alias("rois"))
    sets = top.groupBy("ml_model").agg(F.max(F.when(F.col("pair") == "A vs F", F.col("rois"))).alias("a"), F.max(F.when(F.col("pair") == "R vs F", F.col("rois"))).alias("b"))
    return sets.filter("a IS NOT NULL").select("ml_model", F.coalesce(F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<string>")))), F.lit(0)).alias("overlap"))


def _ranked(spark, d):
    return R.ranked(tab.importances(spark, d), ["pair", "ml_model"], "importance", "roi")


@query(f"SELECT pair, ml_model, roi, CAST(rank AS INTEGER) AS rank FROM ({RANKED})")
def w1_rank_roi(spark, d):
    return _ranked(spark, d).select("pair", "ml_model", "roi", "rank")


@query(f"SELECT pair, ml_model, roi, round(CASE WHEN hi > lo THEN (importance - lo) / (hi - lo) ELSE importance END, 6) + 0.0 AS norm FROM (SELECT *, min(importance) OVER (PARTITION BY pair, ml_model) AS lo, max(importance) OVER (PARTITION BY pair, ml_model) AS hi FROM ({IMP}))")
def w2_minmax(spark, d):
    return R.min_max(tab.importances(spark, d), ["pair", "ml_model"], "importance", "norm").select("pair", "ml_model", "roi", r6("norm", "norm"))


@query(f"SELECT p, round(avg(w) FILTER (sel), 6) + 0.0 AS score FROM (SELECT voxel_id % 6 AS p, abs(list_avg(y)) AS w, list_avg(y) > 0 AS sel FROM ({SIG})) GROUP BY p".replace("round(avg(w) FILTER (sel), 6)", "round(coalesce(avg(w) FILTER (sel), 0), 6)").replace("SELECT p,", "SELECT CAST(p AS INTEGER) AS roi,"))
def a16_feature_to_roi(spark, d):
    """Weights of features (one a voxel) gathered by region: a feature's region is its number modulo 6."""
    s = tab.signals(spark, d)
    weights = s.select(F.col("voxel_id").alias("feature_idx"), F.abs(C.mean_of("y")).alias("weight"), (C.mean_of("y") > 0).alias("selected"))
    layout = s.select(F.col("voxel_id").alias("feature_idx"), (F.col("voxel_id") % 6).cast("int").alias("roi"))
    return R.roi_scores(weights, layout).select("roi", r6("score", "score"))


def _top(spark, d):
    return _ranked(spark, d).filter(F.col("rank") <= TOP_N)


@query(f"SELECT roi, count(*) AS n FROM ({RANKED}) WHERE rank <= 5 GROUP BY roi ORDER BY n DESC, roi LIMIT 15")
def a17_top5_frequency(spark, d):
    return R.top_k(_ranked(spark, d).filter("rank <= 5").groupBy("roi").agg(F.count(F.lit(1)).alias("n")), 15, F.desc("n"), F.col("roi"))


def _mean_importance():
    total = F.sum(F.col("importance").cast("decimal(28, 9)")).cast("double")
    return r6(total / F.count("importance"), "mean_importance")


@query(f"SELECT roi, {MEAN} FROM ({TOP}) GROUP BY roi ORDER BY mean_importance DESC, roi LIMIT 20")
def a18_mean_importance(spark, d):
    return R.top_k(_top(spark, d).groupBy("roi").agg(_mean_importance()), 20, F.desc("mean_importance"), F.col("roi"))


@query(f"SELECT roi, count(*) AS n FROM ({TOP}) GROUP BY roi ORDER BY n DESC, roi LIMIT 20")
def a19_roi_frequency(spark, d):
    return R.top_k(_top(spark, d).groupBy("roi").agg(F.count(F.lit(1)).alias("n")), 20, F.desc("n"), F.col("roi"))


def _summary(top: DataFrame, key: str) -> DataFrame:
    return top.groupBy(key).agg(_mean_importance(), r6(F.stddev_samp("importance"), "std_importance"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT ml_model, {MEAN}, round(stddev_samp(importance), 6) + 0.0 AS std_importance, count(*) AS n FROM ({TOP}) GROUP BY ml_model")
def a20_model_summary(spark, d):
    return _summary(_top(spark, d), "ml_model")


@query(f"SELECT pair, {MEAN}, round(stddev_samp(importance), 6) + 0.0 AS std_importance, count(*) AS n FROM ({TOP}) GROUP BY pair")
def a21_pair_summary(spark, d):
    return _summary(_top(spark, d), "pair")


@query(f"SELECT p.pair, coalesce(n, 0) AS n_rois FROM (SELECT DISTINCT pair FROM ({TOP})) p LEFT JOIN (SELECT pair, count(*) AS n FROM (SELECT pair, roi FROM ({TOP}) GROUP BY ALL HAVING count(DISTINCT ml_model) >= 4) GROUP BY pair) c ON c.pair = p.pair")
def a22_pair_consensus(spark, d):
    return R.consensus(_top(spark, d))


@query(f"SELECT roi, count(*) AS n FROM ({RANKED}) WHERE rank <= 10 GROUP BY roi ORDER BY n DESC, roi LIMIT 15")
def a23_global_frequency(spark, d):
    return R.top_k(_ranked(spark, d).filter("rank <= 10").groupBy("roi").agg(F.count(F.lit(1)).alias("n")), 15, F.desc("n"), F.col("roi"))


@query(f"SELECT (SELECT count(*) FROM (SELECT DISTINCT pair, ml_model FROM ({TOP}))) AS analyses, (SELECT count(DISTINCT roi) FROM ({TOP})) AS rois, (SELECT roi FROM ({TOP}) GROUP BY roi ORDER BY count(*) DESC, roi LIMIT 1) AS modal_roi")
def a24_summary(spark, d):
    """Distinct analyses and regions, and the most frequent region."""
    top = _top(spark, d)
    counts = top.groupBy("roi").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("rois"), F.min(F.struct(-F.col("n"), "roi")).alias("m"))
    analyses = top.select("pair", "ml_model").distinct().agg(F.count(F.lit(1)).alias("analyses"))
    return analyses.crossJoin(counts).select("analyses", "rois", F.col("m.roi").alias("modal_roi"))  # one row each


@query(f"SELECT pair, ml_model, roi, round(importance, 6) + 0.0 AS importance FROM ({TOP}) WHERE pair IN ('A vs F', 'N vs O') AND ml_model IN ('1-URGENT', '5-LOW')")
def p13_filtered_top(spark, d):
    f = _top(spark, d).filter(F.col("pair").isin("A vs F", "N vs O") & F.col("ml_model").isin("1-URGENT", "5-LOW"))
    return f.select("pair", "ml_model", "roi", r6("importance", "importance"))


@query(f"SELECT pair, best_model, round(b, 6) + 0.0 AS best_bacc FROM (SELECT pair, arg_max(ml_model, bacc) AS best_model, max(bacc) AS b FROM ({_BACC}) GROUP BY pair)")
def a30_best_model(spark, d):
    """The best model of each pair."""
    b = _bacc(spark, d).groupBy("pair").agg(F.max_by("ml_model", "bacc").alias("best_model"), F.max("bacc").alias("b"))
    return b.select("pair", "best_model", r6("b", "best_bacc"))


@query(f"SELECT ml_model, string_agg(roi, ', ' ORDER BY k) AS labels FROM (SELECT ml_model, roi, min(n) AS k FROM (SELECT ml_model, roi, row_number() OVER (PARTITION BY ml_model ORDER BY pair, rank) AS n FROM ({RANKED}) WHERE rank <= 5) WHERE n <= 3 GROUP BY ALL) GROUP BY ml_model")
def a31_top_labels(spark, d):
    """The first three labels in row order for each model, each once."""
    top = _ranked(spark, d).filter("rank <= 5").withColumn("n", F.row_number().over(Window.partitionBy("ml_model").orderBy("pair", "rank"))).filter("n <= 3")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "roi"))), lambda s: s["roi"])
    return top.groupBy("ml_model").agg(F.array_join(F.array_distinct(listed), ", ").alias("labels"))


@query(f"SELECT ml_model, pair, round(bacc, 6) + 0.0 AS bacc FROM (SELECT *, row_number() OVER (PARTITION BY ml_model ORDER BY bacc DESC, pair) AS n FROM ({_BACC})) WHERE n <= 3")
def o5_largest_three(spark, d):
    w = Window.partitionBy("ml_model").orderBy(F.desc("bacc"), "pair")
    return _bacc(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 3").select("ml_model", "pair", r6("bacc", "bacc"))


@query("SELECT user_id, CAST(min(n) AS BIGINT) AS shortest FROM (SELECT user_id, dayofmonth(ts) <= 15 AS m, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def a26_shortest_movement(spark, d):
    e = tab.table(spark, d, "events").groupBy("user_id", (F.dayofmonth("ts") <= 15).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("user_id").agg(F.min("n").alias("shortest"))


# --- strings -----------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_extract(url, 'https?://([^/]+)/', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/(\d+)', 1) AS number FROM pages")
def f1_regex_extract(spark, d):
    p = tab.table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"), F.regexp_extract("url", r"/(\d+)", 1).alias("number"))


@query(r"SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '\.html$', '') AS name FROM pages")
def f2_clean_name(spark, d):
    p = tab.table(spark, d, "pages")
    base = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return p.select("page_id", F.regexp_replace(base, r"\.html$", "").alias("name"))


@query(f"SELECT DISTINCT 'ml_' || replace(pair, ' vs ', '_vs_') AS folder, split_part(pair, ' vs ', 1) AS group_0, split_part(pair, ' vs ', 2) AS group_1 FROM ({IMP})")
def f3_pair_parse(spark, d):
    li = tab.table(spark, d, "lineitem").select(F.concat(F.lit("ml_"), "l_returnflag", F.lit("_vs_"), "l_linestatus").alias("folder")).distinct()
    a, b = C.pair_parts(F.col("folder"))
    return li.select("folder", a.alias("group_0"), b.alias("group_1"))


@query("SELECT c_custkey, upper(substr(trim(replace(c_name, 'Customer#', 'sub-')), 5, 9)) AS short FROM customer")
def f4_strings(spark, d):
    c = tab.table(spark, d, "customer")
    return c.select("c_custkey", F.upper(F.substring(F.trim(F.regexp_replace("c_name", "Customer#", "sub-")), 5, 9)).alias("short"))


@query("SELECT c_custkey, CAST(c_custkey // 75 + 1 AS BIGINT) AS movement, c_custkey % 75 AS subject FROM customer")
def f5_index_arithmetic(spark, d):
    c = tab.table(spark, d, "customer")
    return c.select("c_custkey", (F.floor(F.col("c_custkey") / 75) + 1).alias("movement"), (F.col("c_custkey") % 75).alias("subject"))


from . import images, joint, shapes  # noqa: E402, F401  they register their queries
