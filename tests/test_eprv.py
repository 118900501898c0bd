"""The reference's three EPRV/RVAA/backoff tests, re-expressed on tables."""
from moundflow.operators import analytics as AN


def _baseline(spark, rows):
    return spark.createDataFrame(rows, "count string, pitch_type string, zone string, p_throws string, "
                                       "stand string, level int, rv double, n long")


def test_baseline_backoff_levels(spark):
    bl = _baseline(spark, [("1-2", "SL", "5", "R", "R", 0, -0.012, 1), ("1-2", "SL", "5", "*", "*", 3, -0.011, 1),
                           ("1-2", "SL", "*", "*", "*", 7, -0.02, 1), ("1-2", "*", "*", "*", "*", 15, -0.05, 1)])
    q = spark.createDataFrame([(1, "1-2", "SL", 5, "R", "R"), (2, "1-2", "SL", 5, "R", "L"),
                               (3, "1-2", "SL", 999, "R", "R"), (4, "1-2", "FOO", 1, "R", "R")],
                              "id int, count string, pitch_type string, zone int, p_throws string, stand string")
    got = {r.id: (r.baseline_rv, r.baseline_level) for r in AN.baseline_lookup(q, bl).collect()}
    assert abs(got[1][0] - -0.012) < 1e-9 and got[1][1] == "full"
    assert abs(got[2][0] - -0.011) < 1e-9 and got[2][1] == "zone"
    assert abs(got[3][0] - -0.02) < 1e-9 and got[3][1] == "pitch"
    assert abs(got[4][0] - -0.05) < 1e-9 and got[4][1] == "count"


OUTCOMES = ["ball", "called_strike", "swinging_strike", "foul", "inplay_out", "1B", "2B", "3B", "HR", "HBP"]
RV = [-0.01, -0.02, -0.03, -0.005, -0.02, 0.2, 0.4, 0.6, 1.0, 0.0]
P_FF = [0.2, 0.1, 0.05, 0.05, 0.4, 0.1, 0.05, 0.02, 0.02, 0.01]
P_SL = [0.1, 0.05, 0.25, 0.1, 0.3, 0.05, 0.05, 0.02, 0.05, 0.03]


def _run(spark, dist_rows, rv_rows, bl_rows, cands):
    dist = spark.createDataFrame(dist_rows, "count string, pitch_type string, outcome string, p double")
    rv = spark.createDataFrame(rv_rows, "outcome string, count string, rv double")
    bl = _baseline(spark, bl_rows)
    c = spark.createDataFrame(cands, "request_id int, count string, pitch_type string, zone int, "
                                     "p_throws string, stand string")
    per = AN.eprv_candidates(c, AN.eprv_by_context(dist, rv), bl)
    return per, AN.choose_eprv(per)


def test_eprv_rvaa_and_selection(spark):
    dist = [("0-0", "FF", o, p) for o, p in zip(OUTCOMES, P_FF)] + [("0-0", "SL", o, p) for o, p in zip(OUTCOMES, P_SL)]
    rv = [(o, "0-0", v) for o, v in zip(OUTCOMES, RV)]
    bl = [("0-0", "FF", "*", "*", "*", 7, -0.01, 1), ("0-0", "SL", "*", "*", "*", 7, -0.03, 1),
          ("0-0", "*", "*", "*", "*", 15, -0.02, 1)]
    per, best = _run(spark, dist, rv, bl, [(1, "0-0", "FF", 5, "R", "R"), (1, "0-0", "SL", 5, "R", "R")])
    vals = {r.pitch_type: (r.raw_eprv, r.rvaa) for r in per.collect()}
    assert abs(vals["FF"][0] - 0.05825) < 1e-9 and abs(vals["SL"][0] - 0.076) < 1e-9
    assert abs(vals["FF"][1] - 0.06825) < 1e-9 and abs(vals["SL"][1] - 0.106) < 1e-9
    b = best.collect()[0]
    assert b.best_pitch == "FF" and abs(b.rvaa - (b.raw_eprv - b.baseline_rv)) < 1e-9


def test_deterministic_repeated_runs(spark):
    dist = [("0-0", "FF", o, 1.0 if o == "ball" else 0.0) for o in OUTCOMES]
    rv = [("ball", "0-0", -0.01)]
    bl = [("0-0", "FF", "*", "*", "*", 7, -0.01, 1), ("0-0", "*", "*", "*", "*", 15, -0.01, 1)]
    _, a = _run(spark, dist, rv, bl, [(1, "0-0", "FF", 5, "R", "R")])
    _, b = _run(spark, dist, rv, bl, [(1, "0-0", "FF", 5, "R", "R")])
    assert a.collect() == b.collect()


def test_unseen_context_backs_off_to_its_count(spark):
    dist = spark.createDataFrame([("0-0", "FF", "ball", 3), ("0-0", "SL", "1B", 1), ("1-0", "FF", "foul", 2)],
                                 "count string, pitch_type string, outcome string, n long")
    per_count = AN.count_distribution(dist)
    assert {(r["count"], r.outcome): r.p for r in per_count.collect()} == {("0-0", "ball"): 0.75, ("0-0", "1B"): 0.25, ("1-0", "foul"): 1.0}
    rv = spark.createDataFrame([("ball", "0-0", 0.1), ("1B", "0-0", 0.5)], "outcome string, count string, rv double")
    bl = _baseline(spark, [("0-0", "*", "*", "*", "*", 15, 0.0, 1)])
    c = spark.createDataFrame([(1, "0-0", "KN", 5, "R", "R")], "request_id int, count string, pitch_type string, zone int, p_throws string, stand string")
    from pyspark.sql import functions as F
    seen = AN.eprv_by_context(dist.withColumn("p", F.lit(1.0)), rv)
    assert AN.choose_eprv(AN.eprv_candidates(c, seen, bl)).first().best_pitch is None
    best = AN.choose_eprv(AN.eprv_candidates(c, seen, bl, AN.eprv_by_context(per_count, rv))).first()
    assert best.best_pitch == "KN" and abs(best.raw_eprv - 0.2) < 1e-9


def test_best_of_parts_is_the_best_of_all(spark):
    rows = [(1, "FF", 3, -0.1, 0.0, -0.1), (1, "FF", 2, -0.1, 0.0, -0.1), (1, "CU", 9, -0.1, 0.0, -0.1), (1, "SL", 1, 0.2, None, None),
            (2, "SL", 1, 0.2, None, None), (2, "SL", 2, 0.1, None, None), (3, "FF", 1, 0.3, 0.1, 0.2), (3, "FF", 1, 0.3, 0.1, 0.2)]
    c = spark.createDataFrame(rows, "request_id int, pitch_type string, zone int, raw_eprv double, baseline_rv double, rvaa double")
    whole = sorted(map(tuple, AN.choose_eprv(c).collect()))
    assert whole == [(1, "CU", 9, -0.1, 0.0, -0.1, 4), (2, None, None, None, None, None, 2), (3, "FF", 1, 0.3, 0.1, 0.2, 2)]
    parts = AN.choose_eprv(c.withColumn("part", c.zone), "request_id", "part")
    assert sorted(map(tuple, AN.best_choice(parts, "request_id").collect())) == whole


def test_zones_are_judged_per_cell_not_per_request(spark, small_dir, monkeypatch):
    from moundflow.plans.queries import REGISTRY
    seen, judge = [], AN.eprv_candidates
    monkeypatch.setattr(AN, "eprv_candidates", lambda c, *rest: (seen.append(c), judge(c, *rest))[1])
    out = REGISTRY["r12_eprv_rvaa"].spark(spark, small_dir)
    cell = ["count", "_cell_type", "p_throws", "stand", "_unseen", "zone"]
    assert "request_id" not in seen[0].columns and seen[0].count() == seen[0].select(*cell).distinct().count()
    assert out.count() == out.select("request_id").distinct().count() > 0
