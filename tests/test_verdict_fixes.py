"""Readers, draws and percentiles beyond the small fixtures."""
import numpy as np
import pytest

from tsq.operators import align as al
from tsq.operators import metrics as me
from tsq.session import ensure_checkpoint_dir, release_scratch, scratch_path
from tsq.sources import files as fl


def test_ts_file_with_two_dimensions(spark):
    path = scratch_path(spark, "two-dims")
    spark.createDataFrame([("@data",), ("1,2,3:4,?,6:a",), ("7,8,9:1,1,1:b",)], "line string").coalesce(1).write.text(path)
    got = {(r.sample_id, r.dim, r.t): (r.value, r.label) for r in fl.read_ts_text(spark, path).collect()}
    assert len(got) == 12 and got[0, 1, 1] == (None, "a") and got[0, 1, 2] == (6.0, "a") and got[1, 0, 0] == (7.0, "b")
    with pytest.raises(FileNotFoundError):
        fl.read_ts_text(spark, path, "*.ts")


def test_others_are_found_under_a_dominant_class(spark):
    d = spark.createDataFrame([(i, "big" if i % 20 else f"s{i % 3}") for i in range(2000)], "id long, label string")
    label = {r.id: r.label for r in d.collect()}
    got = al.pick_others(d, "label", "id", 3, 1, "neg").collect()
    per = {}
    for r in got:
        per.setdefault(r.id, []).append(r.other_id)
        assert label[r.other_id] != label[r.id]
    assert len(per) == 2000 and all(len(set(x)) == 3 for x in per.values())


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.99, 0.999, 1.0])
def test_percentile_with_an_extreme_outlier(spark, q):
    x = np.random.default_rng(0).normal(size=20_000) ** 2
    x[7] = 1e300
    x[9] = -1e12
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    got = me.exact_percentile(d, "v", q).first().percentile
    np.testing.assert_allclose(got, np.percentile(x, 100 * q), rtol=1e-12)


def test_scratch_tables_can_be_deleted(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    release_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    assert ensure_checkpoint_dir(spark)


def test_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
