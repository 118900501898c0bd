"""Function-level operators without a registered query: cleaning report,
clipping, minimum exposure, column resolution, rolling folds, older trainer."""
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from moundflow.operators import analytics as AN
from moundflow.operators import clean as CL
from moundflow.operators import model as ML
from moundflow.plans.tables import Tables


def test_cleaning_report_counts_in_same_pass(spark, small_dir):
    t = Tables(spark, small_dir)
    obs = Observation("clean")
    out = CL.clean_pitches(t.raw, report=obs)
    n = out.count()
    assert obs.get["rows_in"] == t.raw.count() and n == t.clean.count()


def test_clip_and_min_exposure(spark):
    df = spark.createDataFrame([(1, 120.0), (2, 60.0), (3, 90.0)], "id int, v double")
    assert [r.v for r in CL.clip_columns(df, {"v": (70.0, 105.0)}).orderBy("id").collect()] == [105.0, 70.0, 90.0]
    assert CL.min_exposure(df, "v", 90).count() == 2


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, "FF")], "pitcher_id long, pitch string")
    assert AN.resolve_column(df, ["pitcher", "pitcher_id"]) == "pitcher_id"
    with pytest.raises(ValueError):
        AN.resolve_column(df, ["pitch_type_name"])


def test_rolling_folds(spark, small_dir):
    f = Tables(spark, small_dir).features
    folds = ML.rolling_folds(f, 4)
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert len(sizes) == 4 and sizes[-1] - sizes[0] <= 1
    # folds follow time: every row of fold k precedes every row of fold k+1
    bounds = folds.groupBy("fold").agg(F.min("time_rank").alias("lo"), F.max("time_rank").alias("hi")).orderBy("fold").collect()
    assert all(a.hi < b.lo for a, b in zip(bounds, bounds[1:]))


def test_older_trainer(spark, small_dir):
    model, err = ML.train_random_split(ML.older_features(Tables(spark, small_dir).pitches), max_iter=3)
    rmse = err.first().rmse
    assert rmse is not None and rmse > 0


def test_rolling_validation(spark, small_dir):
    f = Tables(spark, small_dir).features
    m = ML.rolling_validation(f, n_folds=3, max_iter=2, max_depth=3)
    rows = {r.split: r for r in m.collect()}
    assert set(rows) == {"fold_1", "fold_2"} and all(r.rmse > 0 for r in rows.values())
