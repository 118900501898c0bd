"""J12's arsenal side, S10's stored summaries, M6 by a shift in time, M9's fits at once."""
import random
import time

import pytest
from pyspark.sql import functions as F

from moundflow import constants as K
from moundflow.operators import analytics as AN
from moundflow.operators import heuristic as HE
from moundflow.operators import model as ML
from moundflow.plans.tables import Tables


def test_arsenal_of_a_pitcher_without_rows(spark):
    arsenal = spark.createDataFrame([(17, "SL"), (17, "FF"), (170, "CH"), (2170123, "KC"), (5, "Ff7")], "pitcher long, pitch_type string")
    asked = spark.createDataFrame([(i, p) for i, p in enumerate([17, 7, 70, 21701, 1701239, 9, None, 2170123])], "request_id long, pitcher long")
    got = {r.request_id: r.pitches for r in HE._with_pitches(asked, arsenal).collect()}
    default = list(K.HEURISTIC_DEFAULT_ARSENAL)
    assert got == {0: ["FF", "SL"], 1: ["CH", "FF", "Ff7", "KC", "SL"], 2: ["CH", "KC"], 3: ["KC"], 4: default, 5: default, 6: default, 7: ["KC"]}


def test_containing_equals_all_pairs(spark):
    rnd = random.Random(4)
    rows = [("".join(rnd.choice("abc1") for _ in range(rnd.randrange(9))), rnd.choice("xyz"), i) for i in range(80)]
    queries = sorted({"".join(rnd.choice("abc1") for _ in range(rnd.randrange(1, 7))) for _ in range(150)})
    r = spark.createDataFrame(rows, "_text string, _value string, line long")
    q = spark.createDataFrame([(x,) for x in queries], "_q string")
    every = {x: sorted({v for t, v, _ in rows if x in t}) for x in queries}
    assert {g._q: g._values for g in HE.all_containing(q, r.drop("line")).collect()} == {x: v for x, v in every.items() if v}
    first = {x: next((v for t, v, _ in rows if x in t), None) for x in queries}
    assert {g._q: g._value for g in HE.first_containing(q, r, "_value", "line").collect()} == {x: v for x, v in first.items() if v}


def test_stored_summaries_merge(spark):
    rows = [(s, p, b) for s, ps in (("a", [1, 2, 3_000_000_000, None]), ("b", [2, 40_000])) for p in ps for b in (7, None, 32_768)] * 2
    df = spark.createDataFrame(rows, "season string, pitcher long, batter long")
    parts = [AN.season_summary(df.where(F.col("season") == s)) for s in ("a", "b")]
    both = parts[0].unionByName(parts[1])
    assert [tuple(r) for r in AN.merge_seasons(both).collect()] == [("all", 36, 4, 2)]
    assert sorted(tuple(r) for r in AN.merge_seasons(both, F.col("season")).collect()) == [("a", 24, 3, 2), ("b", 12, 2, 2)]
    assert AN.merge_seasons(AN.season_summary(df.limit(0))).count() == 0


def test_shift_importance_by_hand(spark):
    n = 8
    df = spark.createDataFrame([(i, n, float(i), float(i % 2), 2.0 * i) for i in range(n)], "time_rank long, _total int, x double, y double, run_value double")
    got = {r.feature: r for r in ML.permutation_importance(df, ["x", "y"], lambda d: d.withColumn("prediction", 2 * F.col("x"))).collect()}
    way = int(n * 0.381966) + 1
    want = sum((2 * i - 2 * ((i + way) % n)) ** 2 for i in range(n)) / n
    assert got["x"].mse_base == 0 and got["x"].importance == pytest.approx(want) and got["y"].importance == 0


def test_folds_are_fitted_at_once(spark, monkeypatch):
    f = Tables(spark, "/root/testdata/sf0.001").features.checkpoint()
    spans = []
    fit = ML.fit_boosted

    def timed(*a, **b):
        t = time.time()
        out = fit(*a, **b)
        spans.append((t, time.time()))
        return out
    monkeypatch.setattr(ML, "fit_boosted", timed)
    got = {r.split: r for r in ML.rolling_validation(f, n_folds=4, max_iter=3, max_depth=3).collect()}
    assert sorted(got) == ["fold_1", "fold_2", "fold_3"] and all(r.n > 0 and r.rmse > 0 for r in got.values())
    assert max(z for _, z in spans) - min(a for a, _ in spans) < sum(z - a for a, z in spans)


def test_model_importance_equals_column_by_column(spark):
    model, _, _, df = ML.train(Tables(spark, "/root/testdata/sf0.001").features, max_iter=3, max_depth=4)
    rows = ML.time_ordinal(df.filter(F.col("split") == "test").drop("split", "time_rank")).checkpoint()
    some = ["batter_whiff_rate_vs_this_cat", "zone", "pitch_type", "loc_vertical"]
    want = {r.feature: r.importance for r in ML.permutation_importance(rows, some, lambda d: ML.predict(model, d, "prediction")).collect()}
    got = {r.feature: r.importance for r in ML.model_importance(model, rows).collect()}
    assert len(got) == 67 and {c: got[c] for c in some} == pytest.approx(want) and any(v != 0 for v in got.values())
