import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from splinebrook.sources import nifti
from splinebrook.sources.volumes import Volumes, write_volumes

SHAPE = (4, 3, 5)
AFFINE = np.array([[3.0, 0, 0, -9], [0, 3, 0, 1], [0, 0, 4, 2], [0, 0, 0, 1]])


def rows_of(spark, images):
    rows = [(name, *map(int, c), [float(v) for v in image[c]]) for name, image in images.items() for c in np.ndindex(image.shape[:3])]
    return spark.createDataFrame(rows, "image string, x int, y int, z int, y_t array<double>").repartition(7)


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(0)
    return {f"sub-{k}_pc{c}": rng.standard_normal((*SHAPE, 2 + k)).astype("f4") for k in range(3) for c in range(2)}


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("prefix", ["", "file://"])
def test_round_trip(spark, tmp_path, images, compress, prefix):
    path = f"{prefix}{tmp_path}/out"
    write_volumes(rows_of(spark, images), path, SHAPE, 0.75, AFFINE, compress)
    ending = ".nii.gz" if compress else ".nii"
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{n}{ending}" for n in images)
    one = nifti.parse((tmp_path / "out" / f"sub-1_pc0{ending}").read_bytes())
    assert one.tr == 0.75 and np.allclose(one.affine, AFFINE) and np.allclose(one.data, images["sub-1_pc0"])
    read = spark.read.format(Volumes.name()).option("slab_bytes", "200").load(path)
    got = read.collect()
    assert len(got) == 6 * np.prod(SHAPE)
    assert all(np.allclose(r.y_t, images[r.image][r.x, r.y, r.z]) for r in got)


def test_slabs_read_their_own_planes(spark, tmp_path, images):
    write_volumes(rows_of(spark, images), str(tmp_path / "s"), SHAPE, compress=False)
    few, many = (spark.read.format(Volumes.name()).option("slab_bytes", b).load(str(tmp_path / "s")) for b in ("1000000", "1"))
    assert few.rdd.getNumPartitions() == 6 and many.rdd.getNumPartitions() == 30
    assert sorted(map(tuple, few.select("image", "x", "y", "z").collect())) == sorted(map(tuple, many.select("image", "x", "y", "z").collect()))


def test_missing_cells_are_zeros(spark, tmp_path):
    write_volumes(rows_of(spark, {"a": np.ones((1, 1, 1, 2))}), str(tmp_path / "z"), (2, 2, 2))
    got = spark.read.format(Volumes.name()).load(str(tmp_path / "z"))
    assert got.count() == 8 and got.filter(F.col("y_t")[0] != 0).count() == 1


def files_below(path):
    return sorted(f for _, _, names in os.walk(path) for f in names)


def test_a_failed_task_leaves_nothing(spark, tmp_path, images):
    path = str(tmp_path / "f")
    write_volumes(rows_of(spark, {"old": images["sub-0_pc0"]}), path, SHAPE)
    torn = rows_of(spark, images).unionByName(spark.createDataFrame([("sub-2_pc1", 0, 0, 0, [1.0])], "image string, x int, y int, z int, y_t array<double>"))
    with pytest.raises(PySparkException):
        write_volumes(torn, path, SHAPE)
    with pytest.raises(PySparkException):
        write_volumes(rows_of(spark, {"a/b": images["sub-0_pc0"]}), path, SHAPE)
    with pytest.raises(PySparkException):  # a cell outside the volume
        write_volumes(rows_of(spark, images), path, (2, 2, 2))
    assert files_below(path) == ["old.nii.gz"] and os.listdir(path) == ["old.nii.gz"]


def test_names_that_are_there(spark, tmp_path, images):
    path = str(tmp_path / "t")
    one = {"old": images["sub-0_pc0"]}
    write_volumes(rows_of(spark, one), path, SHAPE)
    with pytest.raises(PySparkException):
        write_volumes(rows_of(spark, {**one, "new": one["old"]}), path, SHAPE)
    assert files_below(path) == ["old.nii.gz"]
    write_volumes(rows_of(spark, {"old": one["old"] * 2, "new": one["old"]}), path, SHAPE, mode="overwrite")
    got = spark.read.format(Volumes.name()).load(path).filter("image = 'old'").collect()
    assert files_below(path) == ["new.nii.gz", "old.nii.gz"] and all(np.allclose(r.y_t, 2 * one["old"][r.x, r.y, r.z]) for r in got)
