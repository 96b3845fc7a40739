import numpy as np
import pytest

from splinebrook.operators import preprocess as P
from splinebrook.operators.timeseries import band_pass


def slow_smooth(image, sizes, fwhm):
    out = image
    for axis, size in enumerate(sizes):
        k = P.kernel(fwhm / P.FWHM_OF_SIGMA / size)
        r, n = len(k) // 2, out.shape[axis]
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(out.ndim)], mode="symmetric")
        out = sum(w * np.take(wide, np.arange(i, i + n), axis=axis) for i, w in enumerate(k))
    return out


def rows_of(spark, images):
    rows = [(name, *map(int, c), image[tuple(c)].tolist()) for name, image in images.items() for c in np.ndindex(image.shape[:3])]
    return spark.createDataFrame(rows, "image string, x int, y int, z int, y_t array<double>")


@pytest.mark.parametrize(("shape", "sizes", "fwhm"), [((20, 17, 5), (3.0, 3.0, 4.0), 6.0), ((33, 2, 3), (2.0, 1.0, 5.0), 9.0)])
def test_smoothing_over_blocks(spark, shape, sizes, fwhm):
    rng = np.random.default_rng(0)
    images = {name: rng.standard_normal((*shape, 3)) for name in "ab"}
    turned = np.array([[0, -sizes[1], 0, 5], [sizes[0], 0, 0, 1], [0, 0, sizes[2], 2], [0, 0, 0, 1.0]])
    got = P.gaussian_smooth(rows_of(spark, images), shape, turned, fwhm, ["image"], "y_t").collect()
    want = {name: slow_smooth(image, sizes, fwhm) for name, image in images.items()}
    assert len(got) == 2 * np.prod(shape)
    assert all(np.allclose(r.y_t, want[r.image][r.x, r.y, r.z]) for r in got)


def test_missing_cells_are_zeros_and_stay_missing(spark):
    one = spark.createDataFrame([(1, 5, 5, [1.0, 2.0]), (3, 5, 5, [0.0, 0.0])], "x int, y int, z int, values array<double>")
    got = {r.x: r[3] for r in P.gaussian_smooth(one, (20, 20, 20), np.diag([3.0, 3.0, 3.0, 1.0])).collect()}
    image = np.zeros((20, 20, 20, 2))
    image[1, 5, 5] = [1, 2]
    want = slow_smooth(image, (3, 3, 3), 6.0)
    assert got.keys() == {1, 3} and np.allclose(got[1], want[1, 5, 5]) and np.allclose(got[3], want[3, 5, 5])


def test_blocks_that_only_have_a_halo(spark):
    one = spark.createDataFrame([(15, 15, 15, [1.0])], "x int, y int, z int, values array<double>")
    image = np.zeros((32, 32, 32, 1))
    image[15, 15, 15] = 1
    got = P.gaussian_smooth(one, (32, 32, 32), np.diag([3.0, 3.0, 3.0, 1.0])).collect()
    assert len(got) == 1 and np.allclose(got[0][3], slow_smooth(image, (3, 3, 3), 6.0)[15, 15, 15])


def test_no_width_changes_nothing(spark):
    one = spark.createDataFrame([(1, 5, 5, [1.0, 2.0])], "x int, y int, z int, values array<double>")
    assert P.gaussian_smooth(one, (20, 20, 20), np.eye(4), 0.0).first()[3] == [1.0, 2.0]


@pytest.mark.parametrize("band", [None, (0.01, 0.2)])
def test_confounds_of_each_image(spark, band):
    rng = np.random.default_rng(1)
    n, designs = 80, {}
    rows, table = [], []
    for image, p in (("a", 4), ("b", 2), ("c", 0)):
        design = rng.standard_normal((n, p))
        if p == 4:
            design[:, 3] = design[:, 0] * 2 - design[:, 1]  # says nothing new
        designs[image] = design
        rows += [(image, v, (rng.standard_normal(n) + (design @ np.ones(p) if p else 0)).tolist()) for v in range(40)]
        table += [(image, t, design[t].tolist()) for t in rng.permutation(n).tolist() if p]
    voxels = spark.createDataFrame(rows, "image string, voxel int, y array<double>")
    got = P.cleaned(voxels, spark.createDataFrame(table, "image string, t int, values array<double>"), ["image"], 0.75, band).collect()
    held = {(i, v): np.array(y) for i, v, y in rows}
    assert len(got) == 120
    for r in got:
        x, design = held[r.image, r.voxel], designs[r.image]
        if band:
            x, design = band_pass(x[None], *band, 0.75, 5)[0], band_pass(design.T, *band, 0.75, 5).T if design.size else design
        full = np.column_stack([np.ones(n), design])
        x = x - full @ np.linalg.lstsq(full, x, rcond=1e-10)[0]
        assert np.allclose(r.y, x / x.std(ddof=1), atol=1e-6)


def test_null_confounds_count_as_their_mean(spark):
    rng = np.random.default_rng(3)
    y, c = rng.standard_normal(30), rng.standard_normal(30)
    voxels = spark.createDataFrame([(1, y.tolist())], "image int, y array<double>")

    def with_(first):
        return P.cleaned(voxels, spark.createDataFrame([(1, t, [first if t == 0 else float(c[t])]) for t in range(30)], "image int, t int, values array<double>"), ["image"], 1.0).first().y

    assert np.allclose(with_(None), with_(float(c[1:].mean())))
