"""Properties that must hold on any input (checked on the smallest scale)."""
from pyspark.sql import functions as F

from moundflow.operators import model as ML
from moundflow.operators import recommend as RE
from moundflow.plans.tables import Tables
from moundflow.sources import requests as RQ


def test_softmax_sums_to_one(spark, small_dir):
    t = Tables(spark, small_dir)
    recs = RE.recommend(RQ.requests(spark, small_dir), t.pitcher_arsenals, t.pitcher_profiles, t.batter_wide)
    bad = recs.groupBy("request_id").agg(F.sum("probability").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-9)
    assert bad.count() == 0
    ranks = recs.groupBy("request_id").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"))
    assert ranks.filter(F.col("m") != F.col("n")).count() == 0


def test_shrunk_rate_between_raw_and_league(spark, small_dir):
    from moundflow.functions.pitch import league_average
    p = Tables(spark, small_dir).batter_profiles.withColumn("lg", league_average(F.col("pitch_category"), "whiff_rate"))
    lo, hi = F.least("whiff_rate_raw", "lg"), F.greatest("whiff_rate_raw", "lg")
    assert p.filter((F.col("whiff_rate") < lo - 1e-12) | (F.col("whiff_rate") > hi + 1e-12)).count() == 0


def test_sequence_invariants(spark, small_dir):
    p = Tables(spark, small_dir).pitches
    assert p.filter(F.col("consecutive_same_pitch") >= F.col("pitch_num_in_ab")).count() == 0
    total = F.col("FB_count_in_ab") + F.col("BR_count_in_ab") + F.col("OS_count_in_ab")
    assert p.filter(total > F.col("pitch_num_in_ab")).count() == 0


def test_dedup_keeps_lowest_tiebreak(spark, small_dir):
    t = Tables(spark, small_dir)
    key = ["game_pk", "at_bat_number", "pitch_number"]
    raw = t.raw.dropna(subset=["pitcher", "batter", "pitch_type", "description"])
    want = raw.groupBy(*key).agg(F.min("src_key").alias("src_key"))
    got = t.clean.select(*key, "src_key")
    assert got.count() == want.count() == got.join(want, key + ["src_key"]).count()


def test_split_sizes(spark, small_dir):
    f = Tables(spark, small_dir).features.filter(F.col("run_value").isNotNull())
    n = f.count()
    counts = {r.split: r["count"] for r in ML.time_split(f).groupBy("split").count().collect()}
    assert counts["train"] == int(n * 0.7)
    assert counts["train"] + counts["val"] == int(n * 0.85)
    ranks = ML.time_ordinal(f).select("time_rank")
    assert ranks.distinct().count() == n and ranks.agg(F.max("time_rank")).first()[0] == n - 1


def test_feature_join_keeps_row_count(spark, small_dir):
    t = Tables(spark, small_dir)
    assert t.features.count() == t.pitches.count()
    loose = Tables(spark, small_dir, strict_pitcher_join=False).features.count()
    assert loose >= t.pitches.count()      # the published (pitcher, type) join fans out
