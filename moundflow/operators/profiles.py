"""Batter x category, pitcher x hand x type and batter x zone
profiles.

Every profile is an additive aggregate (counts and sums) followed by a
projection of rates, so Spark runs a partial (map-side) hash aggregate before
the shuffle: a batter or pitcher holding a large share of all pitches is
pre-reduced in every map task and never arrives whole in one reducer.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundflow import constants as K
from moundflow.functions.pitch import (chase_rate, is_batted_ball, is_contact, is_groundball, is_in_zone, is_strike,
                                       is_swing, league_average, pitch_category, regress_to_mean, safe_divide, whiff_rate,
                                       zone_contact_rate)


# ---------------------------------------------------------------------------
# Batter x pitch category (A1, A2, A3)
# ---------------------------------------------------------------------------
def batter_category_counts(raw: DataFrame) -> DataFrame:
    """A1: eleven additive measures per (batter, pitch category).  Rows without a batter,
    a type or a known category have groups of their own, which are left out after: a
    filter would be pushed below the pitch view's join with all its texts."""
    df = raw.withColumn("pitch_category", pitch_category("pitch_type"))
    known = F.col("pitch_type").isNotNull() & F.col("batter").isNotNull() & F.col("pitch_category").isin(*K.CATEGORIES)
    sw, iz, ct = is_swing("description"), is_in_zone("zone"), is_contact("description")
    x = F.col("estimated_woba_using_speedangle")
    counts = df.groupBy("batter", "pitch_category").agg(
        F.count(F.when(known, 1)).alias("_n"),
        F.count("pitch_type").alias("total_pitches"),
        F.sum(sw.cast("long")).alias("swings"),
        F.sum((sw & ~ct).cast("long")).alias("whiffs"),
        F.sum((~iz).cast("long")).alias("out_of_zone"),
        F.sum((sw & ~iz).cast("long")).alias("chases"),
        F.sum((sw & iz).cast("long")).alias("zone_swings"),
        F.sum((ct & iz).cast("long")).alias("zone_contact"),
        F.sum(is_batted_ball("launch_speed").cast("long")).alias("batted_balls"),
        F.sum(is_groundball("launch_angle").cast("long")).alias("groundballs"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("xwoba_sum"),
        F.count(x).alias("xwoba_count"),
    )
    return counts.where(F.col("_n") > 0).drop("_n")


def batter_profiles_from_counts(counts: DataFrame) -> DataFrame:
    """A2: raw rates, shrinkage toward the category's league average, and the
    composite score."""
    cat = F.col("pitch_category")
    df = counts.withColumns({
        "whiff_rate_raw": whiff_rate("whiffs", "swings"),
        "chase_rate_raw": chase_rate("chases", "out_of_zone"),
        "zone_contact_rate_raw": zone_contact_rate("zone_contact", "zone_swings"),
        "gb_rate_raw": safe_divide("groundballs", "batted_balls"),
        "xwoba_raw": safe_divide("xwoba_sum", "xwoba_count", K.XWOBA_RAW_DEFAULT),
    })
    n_for = {"whiff_rate": "swings", "chase_rate": "out_of_zone", "zone_contact_rate": "zone_swings",
             "gb_rate": "batted_balls", "xwoba": "xwoba_count"}
    df = df.withColumns({
        s: regress_to_mean(f"{s}_raw", n_for[s], league_average(cat, s), K.SHRINK_THRESHOLDS[s])
        for s in K.PROFILE_STATS
    })
    a, b, c, d = K.VULNERABILITY_WEIGHTS
    df = df.withColumn("vulnerability_score",
                       (1 - F.col("whiff_rate")) * a + (1 - F.col("chase_rate")) * b
                       + F.col("zone_contact_rate") * c + F.col("xwoba") * d)
    return df.select("batter", "pitch_category", "total_pitches", "swings", "whiff_rate", "chase_rate",
                     "zone_contact_rate", "gb_rate", "xwoba", "vulnerability_score",
                     "whiff_rate_raw", "chase_rate_raw", "zone_contact_rate_raw")


def batter_profiles(raw: DataFrame) -> DataFrame:
    return batter_profiles_from_counts(batter_category_counts(raw))


WIDE_STATS = ["whiff_rate", "chase_rate", "zone_contact_rate", "gb_rate", "xwoba",
              "vulnerability_score", "total_pitches"]


def batter_profiles_wide(profiles: DataFrame) -> DataFrame:
    """A3: one row per batter, ``{stat}_vs_{cat}``; the five rate stats of a
    missing category are filled with league averages."""
    p = profiles.groupBy("batter").pivot("pitch_category", K.CATEGORIES).agg(
        *[F.first(s).alias(s) for s in WIDE_STATS])
    cols = [F.col("batter")]
    for s in WIDE_STATS:
        for c in K.CATEGORIES:
            v = F.col(f"{c}_{s}")
            if s in K.PROFILE_STATS:
                v = F.coalesce(v, F.lit(K.LEAGUE_AVERAGES[c][s]))
            cols.append(v.alias(f"{s}_vs_{c}"))
    return p.select(*cols)


# ---------------------------------------------------------------------------
# Pitcher x hand x pitch type
# ---------------------------------------------------------------------------
def pitcher_profiles(raw: DataFrame, min_pitches: int = K.MIN_PITCHES_PER_TYPE) -> DataFrame:
    """Per (pitcher, hand, type) means and rates, kept when at least
    ``min_pitches``; usage share within the pitcher's kept pitches; gap to the
    pitcher's fastest fastball."""
    df = raw.filter(F.col("pitch_type").isNotNull() & F.col("pitcher").isNotNull() & F.col("p_throws").isNotNull())
    sw, ct = is_swing("description"), is_contact("description")
    agg = df.groupBy("pitcher", "p_throws", "pitch_type").agg(
        F.count("pitch_type").alias("total_pitches"),
        F.avg("release_speed").alias("avg_velo"),
        F.stddev_samp("release_speed").alias("std_velo"),
        F.avg("release_spin_rate").alias("avg_spin"),
        F.avg("pfx_x").alias("avg_pfx_x"),
        F.avg("pfx_z").alias("avg_pfx_z"),
        F.sum(sw.cast("long")).alias("swings"),
        F.sum((sw & ~ct).cast("long")).alias("whiffs"),
        F.sum(is_strike("description").cast("long")).alias("strikes"),
        F.avg("plate_x").alias("avg_plate_x"),
        F.avg("plate_z").alias("avg_plate_z"),
    ).filter(F.col("total_pitches") >= min_pitches)
    agg = agg.withColumns({
        "whiff_rate": safe_divide("whiffs", "swings"),
        "strike_rate": safe_divide("strikes", "total_pitches"),
        "pitch_category": pitch_category("pitch_type"),
    })
    # the profile table is already one row per (pitcher, hand, type): these
    # windows shuffle that small table, not the pitches.
    wp = Window.partitionBy("pitcher")
    agg = agg.withColumns({
        "usage_rate": F.col("total_pitches") / F.sum("total_pitches").over(wp),
        "fb_velo": F.max(F.when(F.col("pitch_category") == "FB", F.col("avg_velo"))).over(wp),
    })
    return agg.withColumn("velo_diff_from_fb", F.col("fb_velo") - F.col("avg_velo"))


def pitcher_arsenals(profiles: DataFrame) -> DataFrame:
    """One row per pitcher.  Ties in usage break by type then hand; the
    best secondary is the non-fastball with the highest whiff rate (ties:
    usage, then type).  Lists are bounded by the pitcher's pitch types."""
    is_fb = F.col("pitch_category") == "FB"
    by_usage = F.sort_array(F.collect_list(F.struct(
        (-F.col("usage_rate")).alias("neg_usage"), F.col("pitch_type"), F.col("p_throws"),
        F.col("pitch_category"), F.col("avg_velo"))))
    secondary = F.sort_array(F.collect_list(F.when(~is_fb, F.struct(
        (-F.col("whiff_rate")).alias("neg_whiff"), (-F.col("usage_rate")).alias("neg_usage"),
        F.col("pitch_type"), F.col("whiff_rate")))))
    g = profiles.groupBy("pitcher").agg(
        by_usage.alias("_u"), secondary.alias("_s"),
        F.max(F.when(is_fb, F.col("avg_velo"))).alias("fb_velo"))
    fbs = F.filter(F.col("_u"), lambda x: x["pitch_category"] == "FB")
    return g.select(
        "pitcher",
        F.col("_u")[0]["p_throws"].alias("p_throws"),
        F.size("_u").cast("long").alias("num_pitch_types"),
        F.array_join(F.transform("_u", lambda x: x["pitch_type"]), ",").alias("pitch_types"),
        F.transform("_u", lambda x: x["pitch_type"]).alias("pitch_type_list"),
        F.try_element_at(fbs, F.lit(1))["pitch_type"].alias("primary_fb"),
        "fb_velo",
        F.try_element_at(F.col("_s"), F.lit(1))["pitch_type"].alias("best_secondary"),
        F.try_element_at(F.col("_s"), F.lit(1))["whiff_rate"].alias("best_secondary_whiff"),
    )


# ---------------------------------------------------------------------------
# Batter x zone
# ---------------------------------------------------------------------------
def _zone_counts(raw: DataFrame) -> DataFrame:
    df = raw.filter(F.col("zone").isNotNull() & F.col("batter").isNotNull())
    sw, ct = is_swing("description"), is_contact("description")
    x = F.col("estimated_woba_using_speedangle")
    return df.groupBy("batter", F.col("zone").cast("double").alias("zone")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(sw.cast("long")).alias("swings"),
        F.sum((sw & ct).cast("long")).alias("contacts"),
        F.sum(x).alias("xwoba_sum"),
        F.count(x).alias("xwoba_count"),
    )


def league_zone_stats(counts: DataFrame) -> DataFrame:
    """14 rows.  A zone needs more than 100 pitches, otherwise the
    defaults; a whiff (contact) rate of exactly 0, or no swings, also falls
    back to .25 (.75), as the published code's ``a and b or c`` does.
    League xwoba is null when no pitch in the zone has one."""
    spark = counts.sparkSession
    lg = (counts.filter(F.col("zone").isin(*[float(z) for z in K.ZONES]))
          .groupBy(F.col("zone").cast("int").alias("zone"))
          .agg(F.sum("n").alias("n"), F.sum("swings").alias("swings"), F.sum("contacts").alias("contacts"),
               F.sum("xwoba_sum").alias("xs"), F.sum("xwoba_count").alias("xc")))
    spine = spark.range(1, 15).select(F.col("id").cast("int").alias("zone"))
    d = K.ZONE_LEAGUE_DEFAULTS
    whiff = (F.col("swings") - F.col("contacts")) / F.col("swings")
    contact = F.col("contacts") / F.col("swings")
    enough = F.coalesce(F.col("n") > K.ZONE_LEAGUE_MIN_ROWS, F.lit(False))
    has_sw = F.col("swings") > 0
    return spine.join(F.broadcast(lg), "zone", "left").select(     # zones 1..14 only
        "zone",
        F.when(enough & has_sw & (whiff != 0), whiff).otherwise(F.lit(d["whiff_rate"])).alias("lg_whiff_rate"),
        F.when(enough & has_sw & (contact != 0), contact).otherwise(F.lit(d["contact_rate"])).alias("lg_contact_rate"),
        F.when(enough, F.col("swings") / F.col("n")).otherwise(F.lit(d["swing_rate"])).alias("lg_swing_rate"),
        F.when(enough, F.try_divide(F.col("xs"), F.col("xc"))).otherwise(F.lit(d["xwoba"])).alias("lg_xwoba"),
    )


def batter_zone_long(raw: DataFrame) -> DataFrame:
    """One row per (batter, zone 1..14).  Fewer than 5 pitches -> league
    values and ``pitches = 0``; otherwise w = n/(n+20) blend; no swings ->
    observed whiff and contact 0 (blended); no xwoba -> league xwoba.

    The batter x 14-zone spine is generated by ``explode(sequence(1, 14))``
    on one row per batter, whose 14 zone aggregates travel as a bounded map
    (at most 14 entries) — no join against the pitch table and no cross join.
    """
    counts = _zone_counts(raw)
    per_batter = counts.groupBy("batter").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("zone").isin(*[float(z) for z in K.ZONES]), F.struct(
            F.col("zone").cast("int"), F.struct("n", "swings", "contacts", "xwoba_sum", "xwoba_count"))))).alias("_m"),
        F.sum(F.when(F.col("zone").isin(*[float(z) for z in K.CHASE_ZONES]), F.col("n"))).alias("_chase_n"),
        F.sum(F.when(F.col("zone").isin(*[float(z) for z in K.CHASE_ZONES]), F.col("swings"))).alias("_chase_sw"),
    )
    k = float(K.ZONE_SHRINK_K)
    chase_w = F.col("_chase_n") / (F.col("_chase_n") + k)
    chase = F.when(F.coalesce(F.col("_chase_n"), F.lit(0)) > 0,
                   chase_w * (F.col("_chase_sw") / F.col("_chase_n")) + (1 - chase_w) * K.CHASE_PRIOR
                   ).otherwise(F.lit(K.CHASE_PRIOR))
    long = per_batter.select("batter", chase.alias("chase_rate_overall"), "_m",
                             F.explode(F.sequence(F.lit(1), F.lit(14))).alias("zone"))
    long = long.withColumn("_z", F.try_element_at(F.col("_m"), F.col("zone"))).drop("_m")
    league = league_zone_stats(counts)
    long = long.join(F.broadcast(league), "zone", "left")   # 14 rows
    n = F.coalesce(F.col("_z.n"), F.lit(0))
    sw = F.col("_z.swings")
    w = n / (n + k)
    obs_swing = sw / n
    obs_contact = F.when(sw > 0, F.col("_z.contacts") / sw).otherwise(F.lit(0.0))
    obs_whiff = F.when(sw > 0, 1 - F.col("_z.contacts") / sw).otherwise(F.lit(0.0))
    obs_x = F.coalesce(F.try_divide(F.col("_z.xwoba_sum"), F.col("_z.xwoba_count")), F.col("lg_xwoba"))
    few = n < K.ZONE_MIN_PITCHES

    def blend(obs, lg):
        return F.when(few, F.col(lg)).otherwise(w * obs + (1 - w) * F.col(lg))

    return long.select(
        "batter", F.col("zone").cast("int").alias("zone"),
        blend(obs_whiff, "lg_whiff_rate").alias("whiff_rate"),
        blend(obs_contact, "lg_contact_rate").alias("contact_rate"),
        blend(obs_swing, "lg_swing_rate").alias("swing_rate"),
        blend(obs_x, "lg_xwoba").alias("xwoba"),
        F.when(few, F.lit(0)).otherwise(n).cast("long").alias("pitches"),
        "chase_rate_overall",
    )


def batter_zone_wide(long: DataFrame) -> DataFrame:
    """A10 + A11: ``zone_{z}_{stat}`` for 14 zones x 5 stats, plus the overall
    chase rate — a pivot of the small long table."""
    stats = K.ZONE_STATS + ["pitches"]
    p = long.groupBy("batter").pivot("zone", K.ZONES).agg(
        *[F.first(s).alias(s) for s in stats], F.first("chase_rate_overall").alias("chase"))
    cols = [F.col("batter")]
    for z in K.ZONES:
        for s in stats:
            cols.append(F.col(f"{z}_{s}").alias(f"zone_{z}_{s}"))
    chase = F.coalesce(*[F.col(f"{z}_chase") for z in K.ZONES])
    return p.select(*cols, chase.alias("chase_rate_overall"))


# ---------------------------------------------------------------------------
# Incremental maintenance: the batter counts are additive
# ---------------------------------------------------------------------------
COUNT_COLS = ["total_pitches", "swings", "whiffs", "out_of_zone", "chases", "zone_swings", "zone_contact",
              "batted_balls", "groundballs", "xwoba_sum", "xwoba_count"]


def merge_batter_counts(*counts: DataFrame) -> DataFrame:
    """Sum stored A1 counts with the counts of new logs (e.g. one day),
    so profiles refresh without re-reading history; rates are then
    re-projected with ``batter_profiles_from_counts``."""
    u = counts[0]
    for c in counts[1:]:
        u = u.unionByName(c)
    return u.groupBy("batter", "pitch_category").agg(*[F.sum(c).alias(c) for c in COUNT_COLS])
