"""Models are published as a whole."""

import os

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer

from fundlens.operators import forecast as FC


def model(spark, value):
    df = spark.range(1)
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT id, {value} AS v FROM __THIS__")]).fit(df)


def value_of(spark, m):
    return m.transform(spark.range(1)).first()["v"]


def test_versions_and_pointer(spark, tmp_path):
    path = str(tmp_path / "store")
    first = FC.save_model(model(spark, 1), path)
    assert value_of(spark, FC.load_model(path)) == 1 and FC.current_version(path) == first
    held = FC.load_model(path)
    second = FC.save_model(model(spark, 2), path)
    assert value_of(spark, FC.load_model(path)) == 2 and value_of(spark, held) == 1
    assert value_of(spark, PipelineModel.load(first)) == 1                # a reader of the old version is not disturbed
    assert FC.drop_versions(path) == [os.path.basename(first)]
    assert FC.current_version(path) == second and value_of(spark, FC.load_model(path)) == 2


class Failing:
    """Writes half a model, then fails, and looks at the store meanwhile."""

    def __init__(self, spark, path):
        self.spark, self.path, self.seen = spark, path, None

    def write(self):
        return self

    def save(self, folder):
        os.makedirs(f"{folder}/stages")
        self.seen = value_of(self.spark, FC.load_model(self.path))
        raise OSError("disk is gone")


def test_a_failed_save_leaves_the_published_model(spark, tmp_path):
    path = str(tmp_path / "store")
    FC.save_model(model(spark, 1), path)
    broken = Failing(spark, path)
    with pytest.raises(OSError):
        FC.save_model(broken, path)
    assert broken.seen == 1 and value_of(spark, FC.load_model(path)) == 1
