"""Hot keys: a group of copies holding a third of all rows must not change
results (it is reduced by partial aggregation before any shuffle)."""
from pyspark.sql import functions as F

from moundflow.operators import clean as CL
from moundflow.operators import profiles as PR
from moundflow.plans.tables import Tables


def _with_hot_copies(raw):
    n = raw.count() // 2                       # copies = 1/3 of the result
    one = raw.orderBy("src_key").limit(1)
    copies = (one.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"))
              .withColumn("src_key", F.col("src_key") + F.lit(10 ** 15) + F.col("_k")).drop("_k"))
    return raw.unionByName(copies), n


def test_hot_copy_group_dedup(spark, small_dir):
    raw = Tables(spark, small_dir).raw
    hot, n = _with_hot_copies(raw)
    assert hot.count() == raw.count() + n
    key = ["game_pk", "at_bat_number", "pitch_number", "src_key"]
    a = sorted(tuple(r) for r in CL.clean_pitches(raw).select(*key).collect())
    b = sorted(tuple(r) for r in CL.clean_pitches(hot).select(*key).collect())
    assert a == b


def test_hot_batter_profile_counts(spark, small_dir):
    raw = Tables(spark, small_dir).raw
    hot, n = _with_hot_copies(raw)
    counts = PR.batter_category_counts(hot)
    base = PR.batter_category_counts(raw)
    one = raw.orderBy("src_key").limit(1).first()
    diff = counts.join(base.select("batter", "pitch_category", F.col("total_pitches").alias("t0")),
                       ["batter", "pitch_category"]).filter(F.col("total_pitches") != F.col("t0")).collect()
    if one.pitch_type is not None and one.batter is not None:
        assert len(diff) <= 1 and all(r.total_pitches - r.t0 == n for r in diff)
