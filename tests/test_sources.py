from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from splinebrook.functions.basis import lambdas
from splinebrook.operators.fpca import FpcaModel, fit_series, smoother_for
from splinebrook.sources import files, nifti
from splinebrook.sources.tables import signals
from splinebrook.streaming.incremental import RunningMoments, fit_stream


def test_nifti_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = rng.random((3, 4, 2, 5))
    for m in (1, 2):
        (tmp_path / f"sub-a_movement{m}-preproc_bold.nii.gz").write_bytes(nifti.encode(data, 0.75))
        (tmp_path / f"sub-a_movement{m}-brain_mask.nii.gz").write_bytes(nifti.encode((data[..., 0] > 0.5).astype(float)))
    (tmp_path / "sub-b_movement1-preproc_bold.nii.gz").write_bytes(nifti.encode(data))
    assert np.isclose(nifti.parse(nifti.encode(data, 0.75)).tr, 0.75)
    v = nifti.voxels(spark, str(tmp_path))
    pairs = nifti.paired(v.select("path").distinct())
    assert pairs.count() == 2
    images = v.join(pairs.select(F.col("image").alias("path")), "path", "left_semi")
    masks = v.join(pairs.select(F.col("mask").alias("path"), "image"), "path").select(F.col("image").alias("path"), "x", "y", "z", "y_t")
    got = nifti.masked(images, masks).collect()
    assert len(got) == 2 * int((data[..., 0].astype("f4") > 0.5).sum())
    assert all(np.allclose(r["y_t"], data[r["x"], r["y"], r["z"]], atol=1e-6) for r in got)


def test_text_artifacts(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "movement1_pc0.txt").write_text("#Eigenfunction 0:\n#Times:\n0.0 0.75 1.5\n#PC temporal profile:\n1.0 -2.0 3.5\n")
    got = files.profiles(spark, str(tmp_path / "p")).orderBy("t").collect()
    assert [(r["movement"], r["t"], r["value"]) for r in got] == [("1", 0.0, 1.0), ("1", 0.75, -2.0), ("1", 1.5, 3.5)]
    (tmp_path / "r" / "ml_NM_vs_mus").mkdir(parents=True)
    (tmp_path / "r" / "ml_NM_vs_mus" / "LR.txt").write_text("Model: LR\nBalanced accuracy: 0.75\n")
    (tmp_path / "r" / "ml_NM_vs_mus" / "note.txt").write_text("nothing here")
    assert [tuple(r)[1:] for r in files.reports(spark, str(tmp_path / "r")).collect()] == [("NM_vs_mus", "LR", 0.75)]
    assert files.newest_files(spark, str(tmp_path / "r"), "ml_(.+?)/").count() == 1
    (tmp_path / "m.csv").write_text(',sub_id,instrument_group,has_jazz,is_train_set\n0,sub-1,Wind,1.0,1\n1,sub-2,,,0\n')
    rows = files.metadata_csv(spark, str(tmp_path / "m.csv")).orderBy("sub_id").collect()
    assert [tuple(r) for r in rows] == [("sub-1", "Wind", 1.0, 1), ("sub-2", "NM", 0.0, 0)]


def test_streams(spark, sf, tmp_path):
    source = signals(spark, sf)
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    s = smoother_for(64)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fitted = fit_stream(stream, s, lambdas(-2, 4, 10))
    running = RunningMoments(spark, str(tmp_path / "moments"))
    query = running.start(fitted, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    # a restart has nothing to add, and loses nothing
    running = RunningMoments(spark, str(tmp_path / "moments"))
    running.start(fitted, str(tmp_path / "checkpoint")).awaitTermination(120)
    whole = FpcaModel.fit(fit_series(source, s, lambdas(-2, 4, 10)), 3)
    assert running.sums()[0] == source.count() and np.allclose(running.model(3).values, whole.values)


def test_result_trees(spark, tmp_path):
    for p, m in (("k12", 2), ("k12", 1), ("k20", 1)):
        (tmp_path / "t" / p).mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p / f"sub-a_movement{m}.txt").write_text("#Averaged\n#Signal:\n1.5 -2.0 3\n")
    root = str(tmp_path / "t")
    assert [(r["params"], r["subject"], r["movement"]) for r in files.listing(spark, root).collect()] == [("k12", "sub-a", 1), ("k20", "sub-a", 1), ("k12", "sub-a", 2)]
    assert [tuple(r) for r in files.params(spark, root).collect()] == [("k12", 2), ("k20", 1)]
    got = files.averaged_signals(spark, f"{root}/k20").orderBy("t").collect()
    assert [(r["movement"], r["t"], r["value"]) for r in got] == [("1", 0, 1.5), ("1", 1, -2.0), ("1", 2, 3.0)]


def test_component_tables(spark):
    models = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [1.0, 2.0]), ("b", 0, [1.0, 2.0, 3.0])], "path string, pc int, vec array<double>")
    assert sorted(map(tuple, files.model_sizes(models).collect())) == [("a", 2, 2, True), ("b", 3, 1, True)]
    assert not files.model_sizes(models.filter("path = 'a'")).first()["differs"]
    old = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "n int, c array<double>")
    assert files.legacy_components(old, {"n": "pc", "c": "profile"}, 0.5, 2).first().asDict() == {"pc": 0, "profile": [1.0, 2.0, 3.0], "times": [1.0, 1.5, 2.0]}
    with pytest.raises(ValueError):
        files.legacy_components(old, {"d": "profile"}, 0.5)


def test_importance_files(spark, tmp_path):
    df = spark.createDataFrame([("a vs b", "LR", 1, 0.25), ("a vs b", "LR", 2, 0.75)], "pair string, ml_model string, roi_index int, importance double")
    files.write_sorted(df, str(tmp_path / "imp"), [F.desc("importance")])
    got = files.roi_importances(spark, [str(tmp_path / "none"), str(tmp_path / "imp")]).orderBy("rank").collect()
    assert [(r["roi_index"], r["roi_label"], r["rank"], r["importance"]) for r in got] == [(2, "roi_2", 1, 0.75), (1, "roi_1", 2, 0.25)]
    with pytest.raises(FileNotFoundError):
        files.roi_importances(spark, [str(tmp_path / "none")])


def test_run_names_and_pairs(spark):
    assert files.tagged("out/", datetime(2020, 1, 2, 3, 4, 5), k=12, d=3) == "out_20200102_030405_d-3_k-12"
    assert files.checked_pairs([["a", "b"], ["b", "c"]], "abc") == [("a", "b"), ("b", "c")]
    for wrong in ([["a"]], [["a", "a"]], [["a", "z"]], [["a", "b"], ["b", "a"]]):
        with pytest.raises(ValueError):
            files.checked_pairs(wrong, "abc")
    images, mask = spark.createDataFrame([("i",), ("j",)], "path string"), spark.createDataFrame([(0, 0, 0, [1.0])], "x int, y int, z int, y_t array<double>")
    assert files.one_mask_for_all(images, mask).count() == 2
