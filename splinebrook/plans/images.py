"""Queries of images on the voxel grid: preprocessing, brain masks, image files."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import masks as K, preprocess as P, timeseries as T
from ..operators.classify import discard
from ..operators.scratch import Steps, folder
from ..sources import tables as tab
from ..sources.volumes import Volumes, write_volumes
from .catalog import GRID, LONG, SIG, VOLUMES, C, query, r6

SIZES = (3.0, 3.0, 4.0)
AFFINE = np.diag([*SIZES, 1.0])
FWHM, TR = 6.0, 0.75
_KERNELS = [P.kernel(FWHM / P.FWHM_OF_SIGMA / s) for s in SIZES]


def grid(spark, d):
    """(shape, rows (x, y, z, y)) of every cell of the voxel grid, zeros where there is no signal."""
    s = tab.signals(spark, d)
    nx = int(s.agg(F.max("voxel_id")).first()[0] // 100 + 1)
    points = s.select(*C.voxel_coordinates(F.col("voxel_id"), *GRID), F.col("y").alias("values")).toDF(*"xyz", "values")
    cells = T.scatter(points, (nx, *GRID), "values")
    volumes = F.coalesce("values", F.array_repeat(F.lit(0.0), VOLUMES))
    return (nx, *GRID), cells.select(*[F.col(c).cast("int").alias(c) for c in "xyz"], volumes.alias("v"))


def _weights(axis: str, k: int) -> str:
    r = len(_KERNELS[k]) // 2
    return f"w{axis} AS (SELECT * FROM (VALUES " + ", ".join(f"({o - r}, CAST({float(v)!r} AS DOUBLE))" for o, v in enumerate(_KERNELS[k])) + f") AS v(o, w))"


def _mirror(cell: str, n: str) -> str:
    at = f"((({cell}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"CASE WHEN {at} < {n} THEN {at} ELSE 2 * {n} - 1 - {at} END"


#: The whole grid and its Gaussian smoothing, axis by axis, as lists of volumes.
SMOOTHED = f"""n AS (SELECT CAST(max(voxel_id) // 100 + 1 AS INTEGER) AS nx FROM ({SIG})), {_weights("x", 0)}, {_weights("y", 1)}, {_weights("z", 2)},
 cells AS MATERIALIZED (SELECT x, y, z, t, coalesce(l.y_, 0.0) AS v FROM (SELECT unnest(range(nx)) AS x FROM n) CROSS JOIN (SELECT unnest(range(10)) AS y) CROSS JOIN (SELECT unnest(range(10)) AS z) CROSS JOIN (SELECT unnest(range({VOLUMES})) AS t)
   LEFT JOIN (SELECT voxel_id, t AS t_, y AS y_ FROM ({LONG})) l ON voxel_id = x * 100 + y * 10 + z AND t_ = t),
 sx AS MATERIALIZED (SELECT c.x, s.y, s.z, s.t, sum(w * v) AS v FROM (SELECT DISTINCT x FROM cells) c CROSS JOIN wx CROSS JOIN n JOIN cells s ON s.x = {_mirror("c.x + o", "nx")} GROUP BY ALL),
 sy AS MATERIALIZED (SELECT s.x, c.y, s.z, s.t, sum(w * v) AS v FROM (SELECT DISTINCT y FROM cells) c CROSS JOIN wy JOIN sx s ON s.y = {_mirror("c.y + o", "10")} GROUP BY ALL),
 sm AS MATERIALIZED (SELECT s.x, s.y, c.z, s.t, sum(w * v) AS v FROM (SELECT DISTINCT z FROM cells) c CROSS JOIN wz JOIN sy s ON s.z = {_mirror("c.z + o", "10")} GROUP BY ALL)"""


@query(f"WITH {SMOOTHED} SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, CAST(t AS INTEGER) AS t, round(v, 6) + 0.0 AS value FROM sm")
def t3_gaussian_smooth(spark, d):
    """Every volume smoothed with a kernel of 6 mm, voxels being 3 x 3 x 4 mm."""
    shape, cells = grid(spark, d)
    smooth = P.gaussian_smooth(cells, shape, AFFINE, FWHM, column="v")
    return smooth.select(*"xyz", F.posexplode("v").alias("t", "value")).select(*"xyzt", r6("value", "value"))


#: Drifts, and the mean signal of a region, as confounds.
_CONFOUNDS = f"SELECT t, CAST(t AS DOUBLE) AS a, CAST(t * t AS DOUBLE) AS b, avg(y) AS c FROM ({LONG}) WHERE roi = 0 GROUP BY t"


def _without(table: str, by: str, columns: list[str], rest: list[str]) -> str:
    """columns less their projections on `by`, over t."""
    return f"(SELECT t, {by}, {', '.join(rest + [f'{c} - {by} * (SELECT sum({c} * {by}) / sum({by} * {by}) FROM {table}) AS {c}' for c in columns])} FROM {table})"


@query(f"""WITH {SMOOTHED}, raw AS (SELECT t, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, c - avg(c) OVER () AS c FROM ({_CONFOUNDS})),
 q1 AS MATERIALIZED {_without("raw", "a", ["b", "c"], [])}, q2 AS MATERIALIZED {_without("q1", "b", ["c"], ["a"])},
 basis AS MATERIALIZED (SELECT t, a / sqrt(sum(a * a) OVER ()) AS a, b / sqrt(sum(b * b) OVER ()) AS b, c / sqrt(sum(c * c) OVER ()) AS c FROM q2),
 cen AS (SELECT x, y, z, t, v - avg(v) OVER (PARTITION BY x, y, z) AS v FROM sm JOIN (SELECT voxel_id FROM ({SIG})) ON voxel_id = x * 100 + y * 10 + z),
 co AS (SELECT x, y, z, sum(v * a) AS ca, sum(v * b) AS cb, sum(v * c) AS cc FROM cen JOIN basis USING (t) GROUP BY ALL),
 res AS (SELECT x, y, z, t, v - ca * a - cb * b - cc * c AS v FROM cen JOIN basis USING (t) JOIN co USING (x, y, z))
 SELECT x * 100 + y * 10 + z AS voxel_id, CAST(t AS INTEGER) AS t, round(v / stddev_samp(v) OVER (PARTITION BY x, y, z), 5) + 0.0 AS z FROM res""")
def t3_preprocess(spark, d):
    """Smoothing, confounds (drifts and a region's mean signal) out, standard scores, for the voxels that have a signal."""
    shape, cells = grid(spark, d)
    inside = tab.signals(spark, d).select("voxel_id", *C.voxel_coordinates(F.col("voxel_id"), *GRID)).toDF("voxel_id", *"xyz")
    smooth = P.gaussian_smooth(cells, shape, AFFINE, FWHM, column="v").join(inside, list("xyz")).select(F.lit(1).alias("image"), "voxel_id", "v")
    region = tab.to_long(tab.signals(spark, d).filter("roi = 0")).groupBy("t").agg(F.avg("y").alias("c"))
    t = F.col("t").cast("double")
    confounds = region.select(F.lit(1).alias("image"), "t", F.array(t, t * t, "c").alias("values"))
    found = P.cleaned(smooth, confounds, ["image"], TR, column="v")
    return found.select("voxel_id", F.posexplode("v").alias("t", "v")).select("voxel_id", "t", r6("v", "z", 5))


def _near(table: str, count: str) -> str:
    """Cells with as many set cells among themselves and their six neighbours as `count` says."""
    return f"(SELECT x + dx AS x, y + dy AS y, z + dz AS z FROM {table} CROSS JOIN (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS o(dx, dy, dz) GROUP BY ALL HAVING {count})"


def _within(table: str) -> str:
    return f"(SELECT v.* FROM {table} v CROSS JOIN n WHERE x BETWEEN 0 AND nx - 1 AND y BETWEEN 0 AND 9 AND z BETWEEN 0 AND 9)"


def _components(name: str, table: str) -> str:
    """Table {name} (x, y, z, root): each cell with the least index that it reaches."""
    return f"""{name}_i AS MATERIALIZED (SELECT x, y, z, (x * 10 + y) * 10 + z AS i FROM {table}),
 {name}_l AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM {name}_i a JOIN {name}_i b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1),
 {name}_r AS (SELECT a, b FROM {name}_l UNION SELECT r.a, l.b FROM {name}_r r JOIN {name}_l l ON r.b = l.a),
 {name} AS MATERIALIZED (SELECT x, y, z, min(b) AS root FROM {name}_i JOIN {name}_r ON a = i GROUP BY x, y, z)"""


_MEANS = f"WITH RECURSIVE {SMOOTHED}, me AS MATERIALIZED (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, round(sum(v) / {VOLUMES}, 9) AS m FROM sm GROUP BY ALL)"
def _gap(lower: float, upper: float) -> str:
    return f"""so AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS k, lead(m) OVER (ORDER BY m) AS nxt, count(*) OVER () AS c FROM me),
 th AS MATERIALIZED (SELECT 0.5 * (m + nxt) AS th FROM so WHERE k >= floor({lower} * c) AND k < least(floor({upper} * c), c - 1) ORDER BY nxt - m DESC, k LIMIT 1)"""


_GAP = _gap(0.2, 0.85)
_RAW = f"WITH RECURSIVE {SMOOTHED}, me AS MATERIALIZED (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, round(sum(v) / {VOLUMES}, 9) AS m FROM cells GROUP BY ALL)"


def _mean_image(spark, d):
    shape, cells = grid(spark, d)
    smooth = P.gaussian_smooth(cells, shape, AFFINE, FWHM, column="v")
    return shape, smooth.select(*"xyz", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / VOLUMES, 9).alias("m"))


@query(f"""{_MEANS}, {_GAP}, m0 AS MATERIALIZED (SELECT x, y, z FROM me, th WHERE m >= th), {_components("co", "m0")},
 big AS MATERIALIZED (SELECT x, y, z FROM co WHERE root = (SELECT root FROM co GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)),
 emp AS MATERIALIZED (SELECT x, y, z FROM me WHERE (x, y, z) NOT IN (SELECT (x, y, z) FROM big)), {_components("ho", "emp")},
 edge AS (SELECT DISTINCT root FROM ho, n WHERE x IN (0, nx - 1) OR y IN (0, 9) OR z IN (0, 9))
 SELECT x, y, z FROM big UNION ALL SELECT x, y, z FROM ho WHERE root NOT IN (SELECT root FROM edge)""")
def s18_epi_mask(spark, d):
    """The brain's voxels of the smoothed mean image: the widest gap, the largest component, holes filled (nothing is opened)."""
    shape, means = _mean_image(spark, d)
    return K.epi_mask(means, shape, opening=0).select("x", "y", "z")


@query(f"""{_MEANS}, {_GAP}, m0 AS MATERIALIZED (SELECT x, y, z FROM me, th WHERE m >= th), e1 AS MATERIALIZED {_near("m0", "count(*) = 7")}, {_components("co", "e1")},
 big AS MATERIALIZED (SELECT x, y, z FROM co WHERE root = (SELECT root FROM co GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)),
 d1 AS MATERIALIZED {_within(_near("big", "count(*) > 0"))}, d2 AS MATERIALIZED {_within(_near("d1", "count(*) > 0"))}
 SELECT x, y, z FROM {_near("d2", "count(*) = 7")}""")
def s18_opened_mask(spark, d):
    """The same with an opening by one cell before the component is chosen."""
    shape, means = _mean_image(spark, d)
    return K.epi_mask(means, shape, opening=1, fill=False).select("x", "y", "z")


@query(f"{_RAW}, {_gap(0.6, 0.9)}, m0 AS MATERIALIZED (SELECT x, y, z FROM me, th WHERE m >= th), {_components('co', 'm0')} SELECT CAST(root AS BIGINT) AS root, CAST(count(*) AS BIGINT) AS voxels FROM co GROUP BY root")
def s18_components(spark, d):
    """Sizes of all components of the mean image as it is, above a gap among its upper values."""
    shape, cells = grid(spark, d)
    means = cells.select(*"xyz", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / VOLUMES, 9).alias("m"))
    mask = means.filter(F.col("m") >= K.gap_threshold(means, "m", 0.6, 0.9)).select("x", "y", "z")
    return K.components(mask, shape).groupBy("root").agg(F.count(F.lit(1)).alias("voxels"))


@query(f"SELECT 'roi-' || roi AS image, x, y, z, CAST(t AS INTEGER) AS t, round(v, 6) + 0.0 AS value FROM (SELECT roi, CAST(voxel_id // 100 AS INTEGER) AS x, CAST((voxel_id // 10) % 10 AS INTEGER) AS y, CAST(voxel_id % 10 AS INTEGER) AS z, t, l.y AS v FROM ({LONG}) l) WHERE v <> 0")
def x2_volumes(spark, d):
    """Each region's voxels written as an image of its own, and all images read again: what is not zero."""
    shape, _ = grid(spark, d)
    cells = tab.signals(spark, d).select(F.concat(F.lit("roi-"), F.col("roi").cast("string")).alias("image"), *C.voxel_coordinates(F.col("voxel_id"), *GRID), F.col("y").alias("y_t")).toDF("image", *"xyz", "y_t")
    steps = Steps(spark, "images")
    path = f"{folder(spark)}/volumes-{uuid.uuid4().hex}"
    write_volumes(cells, path, shape, TR, AFFINE)
    read = spark.read.format(Volumes.name()).load(path).select("image", *"xyz", F.posexplode("y_t").alias("t", "value")).filter("value <> 0")
    found = steps.save(read.select("image", *"xyz", "t", r6("value", "value")))
    discard(spark, path)
    return found
