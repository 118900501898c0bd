"""Heuristic recommender rules: archetype matching, locations, sequences."""
from pyspark.sql import functions as F

from moundflow.operators import heuristic as HE


def _arch(spark):
    return spark.createDataFrame(
        [(10, 0, None, 0.2), (11, 3, "Patient Hitter", 0.1), (12, 7, None, 0.3), (13, None, None, 0.6)],
        "batter long, cluster long, label string, pct_hard_hit double")


def test_archetype_matching(spark):
    req = spark.createDataFrame([(1, "10"), (2, "11"), (3, "12"), (4, "patient"), (5, "zzz"), (6, "13")],
                                "request_id int, batter string")
    got = {r.request_id: r.archetype for r in HE.match_archetypes(req, _arch(spark)).collect()}
    assert got == {1: "Power Hitter", 2: "Patient Hitter", 3: "cluster_7", 4: "Patient Hitter", 5: "unknown",
                   6: "Power Hitter"}


def test_locations(spark):
    df = spark.createDataFrame([("SL", "Power Hitter", False), ("FF", "Contact Hitter", True),
                                ("FF", "unknown", True), ("CH", "Patient Hitter", True), ("ZZ", "x", False)],
                               "p string, a string, r boolean")
    got = [r[0] for r in df.select(HE.heuristic_location(F.col("p"), F.col("a"), F.col("r"))).collect()]
    assert got == ["low-away", "edge-away", "low-in", "low-away", "edge-low-away"]


def test_sequence_and_confidence(spark):
    req = spark.createDataFrame([(1, 99, 10, 2, 0, 0, 0, "1-1")],
                                "request_id long, pitcher long, batter long, outs int, on_1b int, on_2b int, "
                                "on_3b int, count_text string")
    ars = spark.createDataFrame([(99, "FF"), (99, "SL"), (99, "CH")], "pitcher long, pitch_type string")
    r = HE.recommend_sequence(req, _arch(spark), ars).collect()[0]
    # Power: SL 2.5 + two-out .7; CH and FF 1.0 keep alphabetical order
    assert (r.seq_1, r.seq_2, r.seq_3) == ("SL", "CH", "FF")
    assert (r.loc_1, r.loc_2, r.loc_3) == ("low-away", "low-away", "up-in")
    assert r.confidence == 0.99
    assert r.strategy_notes.startswith("Archetype detected: Power Hitter. Pitcher arsenal: CH, FF, SL.")


def test_candidates_share(spark):
    req = spark.createDataFrame([(1, 98, 11, 2, 0, 1, 0, True)],
                                "request_id long, pitcher long, batter long, outs int, on_1b int, on_2b int, "
                                "on_3b int, late_inning boolean")
    ars = spark.createDataFrame([(98, "FF"), (98, "CU")], "pitcher long, pitch_type string")
    rows = HE.next_pitch_candidates(req, _arch(spark), ars).orderBy("rank").collect()
    # Patient: FF 2.0, CU 1.0 + .7 (late, 2 outs) -> 2.0 / 1.7
    assert [(r.pitch, r.pct, r.score) for r in rows] == [("FF", 54.1, 2.0), ("CU", 45.9, 1.7)]
    assert rows[0].is_top and not rows[1].is_top


def test_matching_is_first_by_file_order_and_unique(spark):
    rows = [(1, 20, 1, None, 0.1), (2, 20, 0, None, 0.2), (3, 7, 3, "Patient Hitter", 0.3), (4, 5, None, "Über Slugger", 0.4), (5, None, 2, "No Id", 0.5)]
    arch = spark.createDataFrame(rows, "line int, batter long, cluster long, label string, pct_hard_hit double")
    asked = ["20", " 20 ", "patient", "HITTER", "über", "99", "4", "o i", "", "zz", None, "0.3", "slugger!", "7"]
    req = spark.createDataFrame(list(enumerate(asked)), "request_id int, batter string")
    m = HE.match_archetypes(req, arch, line="line")
    got = {r.request_id: r.archetype for r in m.collect()}
    assert m.count() == len(asked)
    assert got == {0: "Contact Hitter", 1: "Contact Hitter", 2: "Patient Hitter", 3: "Patient Hitter", 4: "Über Slugger", 5: "unknown",
                   6: "Über Slugger", 7: "No Id", 8: "Contact Hitter", 9: "unknown", 10: "unknown", 11: "Patient Hitter", 12: "unknown", 13: "Patient Hitter"}
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_ranked_in_their_request_row(spark, small_dir):
    """R10 neither moves nor sorts candidates: their number does not show in a task's memory."""
    from moundflow.operators import analytics as AN
    from moundflow.plans.tables import Tables
    from moundflow.sources import requests as RQ
    t = Tables(spark, small_dir)
    out = HE.next_pitch_candidates(RQ.requests(spark, small_dir), RQ.archetypes(spark, t.raw.select("batter")), AN.distinct_arsenal(t.raw), "batter_query")
    assert "Window" not in _plan(out)


def test_queries_meet_runs_of_their_own_length(spark):
    """Ids of seven digits share all runs of three with very many rows; only rows that have the whole id meet them."""
    texts = [(i, f"{7_000_000 + 13 * i}\nx", "a" if i % 2 else "b") for i in range(400)]
    rows = spark.createDataFrame(texts, "line long, _text string, label string")
    asked = [f"{7_000_000 + i}" for i in range(0, 4000, 7)] + ["70", "a name that is longer", "7000013\nx", "7000000\nx and more"]
    queries = spark.createDataFrame([(q,) for q in asked], "_q string")
    want = {q: min(hit)[1] for q in asked if (hit := [(i, label) for i, text, label in texts if q in text])}
    assert {r._q: r._value for r in HE.first_containing(queries, rows, "label", "line").collect()} == want
    pairs = HE._long_hits(queries, rows.select("_text", F.col("label").alias("_value")))
    assert pairs.count() == 0 and HE._runs(queries, rows.select("_text", "label")).where("length(_q) = 7").groupBy("_q").count().agg(F.max("count")).first()[0] <= 2
