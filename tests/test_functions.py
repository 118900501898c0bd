"""Golden values for the scalar rules (Column expressions)."""
from pyspark.sql import functions as F

from moundflow.functions import location as L
from moundflow.functions import pitch as P
from moundflow.operators.recommend import reasoning
from moundflow.operators.runvalue import run_expectancy


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_pitch_category(spark):
    got = one(spark, P.pitch_category("t"), "t string", [("FF",), ("sl",), ("CH",), ("XX",), (None,), ("IN",), ("PO",)])
    assert got == ["FB", "BR", "OS", "UNKNOWN", "UNKNOWN", "FB", "OS"]


def test_outcome_class_order_and_quirk(spark):
    rows = [("ball", None), ("blocked_ball", None), ("foul_tip", None), ("called_strike", None),
            ("swinging_strike_blocked", None), ("missed_bunt", None), ("hit_into_play", "single"),
            ("hit_into_play", "grounded_into_double_play"), ("hit_into_play", "field_out"),
            ("hit_by_pitch", None), (None, None)]
    got = one(spark, P.outcome_class("d", "e"), "d string, e string", rows)
    assert got == ["ball", "ball", "foul", "called_strike", "swinging_strike", "swinging_strike", "in_play_hit",
                   "in_play_hit", "in_play_out", "other", "other"]


def test_swing_contact_zone(spark):
    df = spark.createDataFrame([("foul", 5), ("swinging_strike", 11), ("ball", None), (None, 9)], "d string, z long")
    got = df.select(P.is_swing("d"), P.is_contact("d"), P.is_in_zone("z")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (True, False, False), (False, False, False),
                                        (False, False, True)]


def test_regress_to_mean(spark):
    df = spark.createDataFrame([(0.5, 25, 0.3), (0.5, 0, 0.3), (0.5, None, 0.3)], "o double, n long, m double")
    got = [r[0] for r in df.select(P.regress_to_mean("o", "n", F.col("m"), 100)).collect()]
    assert abs(got[0] - 0.4) < 1e-12      # w = 25/(25+25)
    assert got[1] == 0.3 and got[2] == 0.3


def test_safe_divide(spark):
    got = one(spark, P.safe_divide("a", "b", 0.32), "a double, b double", [(1.0, 4.0), (1.0, 0.0), (1.0, None)])
    assert got == [0.25, 0.32, 0.32]


def test_count_delta(spark):
    rows = [(0, 0, "ball"), (3, 1, "strike"), (1, 2, "foul"), (1, 1, "foul"), (2, 0, "called_strike"), (0, 0, "x")]
    got = one(spark, P.count_delta("b", "s", "o"), "b int, s int, o string", rows)
    assert got == [0.032, -0.078, 0.0, -0.056, -0.047, 0.0]


def test_zone_geometry(spark):
    rows = [(0.0, 2.5), (-0.83, 3.5), (0.83, 1.5), (0.0, 3.6), (0.0, 1.4), (-0.9, 2.5), (0.9, 2.5), (0.0, 2.3)]
    got = one(spark, L.coords_to_zone("x", "z"), "x double, z double", rows)
    assert got == [5, 1, 9, 11, 12, 13, 14, 5]
    grid = [(r.cell_no, r.zone) for r in L.location_grid(spark).orderBy("cell_no").collect()]
    assert len(grid) == 25 and grid[0] == (0, 13) and grid[12] == (12, 5)


def test_buckets_training_vs_scoring(spark):
    df = spark.createDataFrame([(1.8,), (-5.0,), (0.3,)], "v double")
    got = df.select(L.loc_vertical("v"), L.loc_vertical_scoring("v"), L.loc_horizontal("v"),
                    L.loc_horizontal_scoring("v")).collect()
    assert tuple(got[0]) == ("low", "mid_low", "outside_outside", "outside_outside")
    assert tuple(got[1])[0] is None and tuple(got[1])[2] is None       # out of (0,6] / (-5,5]
    assert tuple(got[2])[2] == "middle" and tuple(got[2])[3] == "outside"


def test_location_label_and_rule(spark):
    got = one(spark, L.location_label("x", "z"), "x double, z double", [(0.0, 2.3), (-0.6, 3.3), (0.6, 1.0)])
    assert got == ["middle-mid", "inside-high", "outside-low"]
    got = one(spark, L.rule_based_location("p", "s"), "p string, s string", [("FF", "R"), ("SI", "L"), ("ZZ", "L")])
    assert got == ["away-low", "inside-or-outside-low", "away-low"]


def test_parse_count_and_adjusted_re(spark):
    df = spark.createDataFrame([("3-1",), ("bad",), ("5-4",), ("0-2",)], "t string")
    b, s = P.parse_count("t")
    assert [tuple(r) for r in df.select(b, s).collect()] == [(3, 1), (0, 0), (3, 2), (0, 2)]
    re = one(spark, P.count_adjusted_re("re", "b", "s"), "re double, b int, s int",
             [(1.0, 3, 1), (1.0, 0, 2), (1.0, 3, 2), (1.0, 2, 1), (1.0, 0, 1)])
    assert [round(x, 6) for x in re] == [1.15, 0.85, 1.0, round(1 + 0.1 / 3, 6), 0.95]


def test_run_expectancy_lookup(spark):
    got = one(spark, run_expectancy("o", "a", "b", "c"), "o int, a int, b int, c int",
              [(0, 0, 0, 0), (2, 1, 1, 1), (5, 1, 0, 0), (None, 0, 1, 0)])
    assert got == [0.481, 0.736, 0.224, 1.1]


def test_reasoning_text(spark):
    df = spark.createDataFrame([("BR", 0.5, 0.5, 0.25, 0, 2), ("FB", 0.22, 0.27, 0.32, 3, 0),
                                ("UNKNOWN", 0.1, 0.2, 0.4, 1, 1)],
                               "c string, w double, ch double, x double, b int, s int")
    got = [r[0] for r in df.select(reasoning(F.col("c"), F.col("w"), F.col("ch"), F.col("x"), F.col("b"),
                                             F.col("s"))).collect()]
    assert got[0] == ("Batter has high whiff rate vs BR (50%); Batter chases BR pitches (50%); "
                      "Weak contact expected (0.250 xwOBA); Put-away count favors offspeed/breaking")
    assert got[1] == "Need strike - fastball for command"
    assert got[2] == "Batter makes good contact vs UNKNOWN; Dangerous contact potential (0.400 xwOBA)"
