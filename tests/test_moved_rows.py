"""What a plan moves: only the columns that are read, wide rows as seldom as can be."""
import pytest
from pyspark.sql import functions as F

from moundflow.operators import clean as CL
from moundflow.operators import model as ML
from moundflow.plans.queries import REGISTRY
from moundflow.plans.tables import Tables

UNREAD = ("launch_speed", "woba_value", "pfx_x", "release_spin_rate")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["w02_run_value", "w04_sequence_features", "e14_outcome_flags", "w14_extra_sequence", "e26_rule_based_location", "a20_outcome_run_values"])
def test_deduplication_carries_what_is_read(spark, small_dir, name):
    plan = _plan(REGISTRY[name].spark(spark, small_dir))
    assert "min_by(" in plan and not [c for c in UNREAD if c in plan]


def test_columns_of_another_log_stay(spark, small_dir):
    """A log with the other side's score only, and home and away scores."""
    raw = Tables(spark, small_dir).raw.drop("post_bat_score").withColumns({"post_fld_score": F.col("fld_score") + 1, "home_score": F.lit(1), "away_score": F.lit(2)})
    t = Tables(spark, small_dir, raw=raw)
    assert t.pitches_with().agg(F.min("runs_on_play"), F.max("runs_on_play")).first() == (1.0, 1.0)
    assert "is_close_game" in t.features.columns


def test_features_move_a_pitch_twice(spark, small_dir):
    """The pitches meet the pitcher's profile and the batter's, zones included."""
    t = Tables(spark, small_dir)
    for name in ("raw", "batter_wide", "pitcher_profiles", "zone_long", "pitches"):
        t.materialize(name)
    joins = [line for line in _plan(t.features).splitlines() if "Join " in line]
    assert sum("LeftOuter" in j for j in joins) == 2 and sum("FullOuter" in j for j in joins) == 1


def test_cuts_in_time_count_exactly(spark):
    rows = [(d, g, a, 1, i) for i, (d, g, a) in enumerate([(None, 1, 1), ("2024-03-01", 2, 1), ("2024-03-01", 2, 1), ("2024-03-01", None, 1), ("2024-04-01", 1, 2),
                                                            ("2024-04-01", 1, 1), (None, None, None), ("2024-02-01", 9, 9)])]
    df = spark.createDataFrame(rows, "game_date string, game_pk long, at_bat_number long, pitch_number long, _id long")
    df = df.withColumn("game_date", F.col("game_date").cast("date"))
    order = [7, 1, 2, 3, 5, 4, 0, 6]         # nulls last, equal times by _id
    total, conditions = ML.time_cuts(df, lambda n: list(range(n + 1)))
    assert total == 8
    for k, c in enumerate(conditions):
        assert {r["_id"] for r in df.where(c).collect()} == set(order[:k])
    assert ML.time_cuts(df.limit(0), lambda n: [n])[0] == 0


def test_split_rows_are_those_of_the_time_split(spark, small_dir):
    f = Tables(spark, small_dir).features
    key = ["game_pk", "at_bat_number", "pitch_number"]
    want = {tuple(r) for r in ML.time_split(f.filter(F.col("run_value").isNotNull())).select(*key, "split").collect()}
    df, _, _, n = ML.split_rows(f)
    got = [tuple(r) for r in df.select(*key, "split").collect()]
    assert len(got) == n and set(got) == want


@pytest.mark.parametrize("name", ["w14_extra_sequence", "w04_sequence_features", "e26_rule_based_location"])
def test_conditions_do_not_repeat_the_view(spark, small_dir, name):
    """The log's columns are computed once, not again in a join's or a filter's condition."""
    lines = [line.strip(" :+-") for line in _plan(REGISTRY[name].spark(spark, small_dir)).splitlines()]
    assert not [x for x in lines if x.startswith(("Join", "Filter")) and "CASE WHEN" in x]


def test_deduplication_leaves_out_steps_nobody_reads(spark, small_dir):
    plan = _plan(REGISTRY["w14_extra_sequence"].spark(spark, small_dir))
    assert not [c for c in ("bat_score", "on_1b", "release_speed", "inning") if f"AS {c}#" in plan]


def test_first_complete_row_is_kept_whole(spark):
    """The first row of a pitch that has the required fields, all its groups of columns from one row."""
    rows = [(1, 1, 1, 1, None, 10, "FF", "ball", 3, 90.0, "x"), (1, 1, 1, 2, 7, 11, "SI", "foul", 4, 91.0, None), (1, 1, 1, 3, 8, 12, "SL", "ball", 5, 92.0, "z"),
            (1, 1, 2, 4, 7, 10, None, "ball", 3, 90.0, "x"), (1, 1, 2, 5, 7, 10, "FF", None, 3, 90.0, "x"),
            (2, 1, 1, 9, 7, 10, "FF", "foul", 1, 80.0, "b"), (2, 1, 1, 8, 7, 10, "CU", "foul", 2, None, "a")]
    df = spark.createDataFrame(rows, "game_pk int, at_bat_number int, pitch_number int, src_key long, pitcher int, batter int, pitch_type string, description string, inning int, release_speed double, own string")
    got = sorted(tuple(r) for r in CL.clean_pitches(df).collect())
    assert got == [rows[1], rows[6]] and CL.clean_pitches(df).columns == df.columns
    nan = df.withColumn("pitcher", F.when(F.col("src_key") == 2, F.lit(float("nan"))).otherwise(F.col("pitcher").cast("double")))
    assert sorted(r.src_key for r in CL.clean_pitches(nan).collect()) == [3, 8]


def test_features_leave_out_profiles_nobody_reads(spark, small_dir):
    """Where no column of a profile is read, the pitches do not meet it."""
    read = Tables(spark, small_dir).features.select("game_pk", "pitch_type", "loc_horizontal", "in_zone", "run_value")
    assert "Join LeftOuter" not in _plan(read)
    rows = Tables(spark, small_dir).features
    assert rows.groupBy("game_pk", "at_bat_number", "pitch_number").count().where("count > 1").isEmpty()
    assert "Join FullOuter" in _plan(rows.select("batter_xwoba_at_zone", "xwoba_vs_FB"))


def test_contexts_are_not_broadcast(spark, small_dir, monkeypatch):
    """R12's cells, bounded by the game, are the side that is broadcast, however small the files of the contexts are."""
    from moundflow.operators import analytics as AN
    seen, own = [], AN.best_choice
    monkeypatch.setattr(AN, "best_choice", lambda choices, *by: seen.append((choices, by)) or own(choices, *by))
    REGISTRY["r12_eprv_rvaa"].spark(spark, small_dir)
    of_context = next(choices for choices, by in seen if "pitcher" in by)
    first = next(line for line in _plan(of_context).splitlines() if "Join Inner" in line)
    assert "rightHint=(strategy=broadcast)" in first and "leftHint" not in first


def test_a_pitch_meets_its_copies_as_one_value(spark, small_dir):
    """Features of all steps: one value and its tie-break are moved, and categories are not moved at all."""
    t = Tables(spark, small_dir)
    assert _plan(t.features).count("min_by(") > _plan(t.whole_features).count("min_by(") == 1
    key = ["game_pk", "at_bat_number", "pitch_number"]
    assert sorted(map(tuple, t.features.orderBy(*key).collect()), key=str) == sorted(map(tuple, t.whole_features.orderBy(*key).collect()), key=str)
    joins = [line for line in _plan(t.whole_features).splitlines() if "AS last_pitch_category" in line or "AS pitch_category" in line]
    assert joins and not [line for line in joins if line.strip(" :+-").startswith("Project") and "_we" in line]


def test_categories_are_not_judged_below_the_join(spark, small_dir):
    """A1 leaves out unknown categories, and rows without a batter or a type, after the aggregate."""
    from moundflow.operators import profiles as PR
    counts = PR.batter_category_counts(Tables(spark, small_dir).raw)
    lines = [line.strip(" :+-") for line in _plan(counts).splitlines()]
    assert not [x for x in lines if x.startswith(("Join", "Filter")) and "CASE WHEN" in x]
    log = spark.createDataFrame([(1, "FF"), (1, "ff"), (1, "XX"), (1, None), (None, "FF"), (2, "XX")], "batter int, pitch_type string").selectExpr(
        "*", "'ball' AS description", "1 AS zone", "1.0D AS launch_speed", "1.0D AS launch_angle", "CAST(NULL AS DOUBLE) AS estimated_woba_using_speedangle")
    assert [tuple(r)[:3] for r in PR.batter_category_counts(log).collect()] == [(1, "FB", 2)]
