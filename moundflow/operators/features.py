"""The model's feature table.

The pitch table is the big side of every join here; the profiles are one
row per player (or player x 3 categories / x 14 zones).  Building the plan
starts no job: adaptive execution broadcasts a lookup when its real size is
under ``spark.sql.adaptive.autoBroadcastJoinThreshold``, splits skewed players
otherwise.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundflow import constants as K
from moundflow.functions.location import in_zone_flag, loc_horizontal, loc_vertical
from moundflow.functions.pitch import clamp, league_average, pitch_category, pitch_category_or_null

PITCHER_PROFILE_COLS = ["avg_velo", "std_velo", "avg_spin", "avg_pfx_x", "avg_pfx_z",
                        "whiff_rate", "strike_rate", "usage_rate", "velo_diff_from_fb"]
ZONE_DEFAULTS = {"swing_rate": 0.5, "whiff_rate": 0.25, "contact_rate": 0.75, "xwoba": 0.32}

COUNT_FEATURES = ["count_balls", "count_strikes", "is_ahead_in_count", "is_behind_in_count",
                  "is_two_strikes", "is_three_balls", "is_full_count", "is_first_pitch"]
SITUATION_FEATURES = ["outs", "is_two_outs", "on_1b", "on_2b", "on_3b", "runners_on", "risp",
                      "bases_empty", "bases_loaded", "is_late_inning", "is_close_game"]
MATCHUP_FEATURES = ["same_hand", "platoon_advantage"]
BATTER_FEATURES = ["batter_whiff_rate_vs_this_cat", "batter_chase_rate_vs_this_cat",
                   "batter_zone_contact_rate_vs_this_cat", "batter_gb_rate_vs_this_cat",
                   "batter_xwoba_vs_this_cat",
                   "whiff_rate_vs_FB", "whiff_rate_vs_BR", "whiff_rate_vs_OS",
                   "chase_rate_vs_FB", "chase_rate_vs_BR", "chase_rate_vs_OS",
                   "xwoba_vs_FB", "xwoba_vs_BR", "xwoba_vs_OS"]
PITCHER_FEATURES = ["pitcher_avg_velo", "pitcher_avg_spin", "pitcher_avg_pfx_x", "pitcher_avg_pfx_z",
                    "pitcher_whiff_rate", "pitcher_strike_rate", "pitcher_usage_rate",
                    "pitcher_velo_diff_from_fb"]
SEQUENCE_FEATURES = ["pitch_num_in_ab", "same_as_last", "consecutive_same_pitch", "speed_delta"]
INTERACTION_FEATURES = ["whiff_interaction", "chase_opportunity", "speed_change_magnitude",
                        "two_strike_whiff_boost"]
LOCATION_FEATURES = ["plate_x", "plate_z", "zone", "in_zone", "batter_swing_rate_at_zone",
                     "batter_whiff_rate_at_zone", "batter_contact_rate_at_zone", "batter_xwoba_at_zone"]
CATEGORICAL_FEATURES = ["pitch_type", "pitch_category", "last_pitch_type", "last_pitch_category",
                        "stand", "p_throws", "loc_horizontal", "loc_vertical"]
NUMERIC_FEATURES = (COUNT_FEATURES + SITUATION_FEATURES + MATCHUP_FEATURES + BATTER_FEATURES
                    + PITCHER_FEATURES + SEQUENCE_FEATURES + INTERACTION_FEATURES + LOCATION_FEATURES)
ALL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
#: What the features read of the log beside what the pitch steps do.
LOG_COLUMNS = ["p_throws", "stand", "balls", "strikes", "score_diff", "fld_score", "home_score", "away_score", "plate_x", "plate_z"]
ID_COLS = ["game_pk", "game_date", "pitcher", "batter", "at_bat_number", "pitch_number"]


def stat_for_category(stat: str, category: Column) -> Column:
    """The wide profile's ``{stat}_vs_{cat}`` for this pitch's category;
    missing (no profile, or UNKNOWN category) -> league average (FB if unknown)."""
    pick = None
    for c in K.CATEGORIES:
        cond = category == c
        pick = F.when(cond, F.col(f"{stat}_vs_{c}")) if pick is None else pick.when(cond, F.col(f"{stat}_vs_{c}"))
    return F.coalesce(pick, league_average(category, stat))


def join_batter_features(df: DataFrame, wide: DataFrame) -> DataFrame:
    """J1 + J2."""
    df = df.join(wide, "batter", "left")
    if "pitch_category" not in df.columns:
        df = df.withColumn("pitch_category", pitch_category("pitch_type"))
    return df.withColumns({f"batter_{s}_vs_this_cat": stat_for_category(s, F.col("pitch_category"))
                           for s in K.PROFILE_STATS})


def join_pitcher_features(df: DataFrame, profiles: DataFrame, strict: bool = True) -> DataFrame:
    """Profile of this (pitcher, hand, type), columns prefixed ``pitcher_``.
    ``strict=False`` joins on (pitcher, type) only, reproducing the published
    fan-out for pitchers who throw with both hands."""
    keys = ["pitcher", "p_throws", "pitch_type"] if strict else ["pitcher", "pitch_type"]
    p = profiles.select(*keys, *[F.col(c).alias(f"pitcher_{c}") for c in PITCHER_PROFILE_COLS])
    return df.join(p, keys, "left")


def add_location_features(df: DataFrame, zone_long: DataFrame | None) -> DataFrame:
    """F8 + J4/J5: buckets, in-zone flag, and the batter's stats at this zone
    (zone outside 1..14 or null -> defaults; batter without a profile -> null)."""
    df = df.withColumns({
        "loc_horizontal": loc_horizontal("plate_x"),
        "loc_vertical": loc_vertical("plate_z"),
        "in_zone": in_zone_flag("zone"),
    })
    if zone_long is None:
        return df
    if "_zones" in df.columns:          # the batter's zones came with the profile
        at = F.try_element_at("_zones", F.floor("zone").cast("long"))
        valid = F.coalesce((F.col("zone") >= 1) & (F.col("zone") <= 14), F.lit(False))
        return df.withColumns({f"batter_{s}_at_zone": F.when(valid, at[s]).otherwise(F.lit(d)) for s, d in ZONE_DEFAULTS.items()}).drop("_zones")
    z = zone_long.select(F.col("batter").alias("_zbatter"), F.col("zone").cast("long").alias("_zone"),
                         *[F.col(s).alias(f"_z_{s}") for s in ZONE_DEFAULTS])
    zk = F.col("zone")
    valid = F.coalesce((zk >= 1) & (zk <= 14), F.lit(False))
    df = df.join(z, (F.col("batter") == F.col("_zbatter")) & (F.floor(zk).cast("long") == F.col("_zone")), "left")
    df = df.withColumns({f"batter_{s}_at_zone": F.when(valid, F.col(f"_z_{s}")).otherwise(F.lit(d))
                         for s, d in ZONE_DEFAULTS.items()})
    return df.drop("_zbatter", "_zone", *[f"_z_{s}" for s in ZONE_DEFAULTS])


def add_situational_features(df: DataFrame) -> DataFrame:
    """F1-F6."""
    b, s = F.col("balls"), F.col("strikes")

    def flag(c):
        return F.coalesce(c.cast("int"), F.lit(0))

    cols = {
        "same_hand": flag(F.col("stand") == F.col("p_throws")),
        "platoon_advantage": F.coalesce((F.col("stand") != F.col("p_throws")).cast("int"), F.lit(1)),
        "count_balls": F.coalesce(b.cast("int"), F.lit(0)),
        "count_strikes": F.coalesce(s.cast("int"), F.lit(0)),
        "is_ahead_in_count": flag(s > b),
        "is_behind_in_count": flag(b > s),
        "is_two_strikes": flag(s == 2),
        "is_three_balls": flag(b == 3),
        "is_full_count": flag((b == 3) & (s == 2)),
        "is_first_pitch": flag((b == 0) & (s == 0)),
        "runners_on": clamp(F.col("on_1b") + F.col("on_2b") + F.col("on_3b"), 0, 3),
        "risp": flag((F.col("on_2b") == 1) | (F.col("on_3b") == 1)),
        "outs": clamp(F.coalesce(F.col("outs_when_up").cast("int"), F.lit(0)), 0, 2),
    }
    df = df.withColumns(cols)
    df = df.withColumns({
        "bases_empty": flag(F.col("runners_on") == 0),
        "bases_loaded": flag(F.col("runners_on") == 3),
        "is_two_outs": flag(F.col("outs") == 2),
    })
    if "score_diff" in df.columns:
        diff = F.col("score_diff")
    elif {"bat_score", "fld_score"} <= set(df.columns):
        diff = F.col("fld_score") - F.col("bat_score")
    elif {"home_score", "away_score", "inning_topbot"} <= set(df.columns):
        diff = F.when(F.col("inning_topbot") == "Bot", F.col("home_score") - F.col("away_score")) \
                .otherwise(F.col("away_score") - F.col("home_score"))
    else:
        diff = None
    if diff is not None:
        df = df.withColumn("score_diff", diff)
        df = df.withColumn("is_close_game", flag(F.abs(F.col("score_diff")) <= 2))
    df = df.withColumn("inning_num", F.coalesce(F.col("inning").cast("int"), F.lit(1)))
    return df.withColumn("is_late_inning", flag(F.col("inning_num") >= 7))


def add_interaction_features(df: DataFrame) -> DataFrame:
    """F7."""
    bw = F.col("batter_whiff_rate_vs_this_cat")
    return df.withColumns({
        "whiff_interaction": F.coalesce(bw * F.col("pitcher_whiff_rate"), F.lit(0.0)),
        "chase_opportunity": F.col("batter_chase_rate_vs_this_cat") * F.col("is_ahead_in_count"),
        "speed_change_magnitude": F.coalesce(F.abs(F.col("pitcher_velo_diff_from_fb")), F.lit(0.0)),
        "two_strike_whiff_boost": F.col("is_two_strikes") * bw,
    })


def batter_zones(zone_long: DataFrame) -> DataFrame:
    """One row per batter: ``_zones``, its stats by zone (14 at most)."""
    return zone_long.groupBy("batter").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("zone").cast("long"), F.struct(*ZONE_DEFAULTS)))).alias("_zones"))


def build_features(pitches: DataFrame, batter_wide: DataFrame, pitcher_prof: DataFrame,
                   zone_long: DataFrame | None, strict: bool = True) -> DataFrame:
    """ids + 67 features + target.  The per-player lookups are plain joins
    that adaptive execution turns into broadcasts by real size.  Where they are
    too large for that, each moves the pitches once: the pitcher's comes first, as
    it adds fewer columns, and the batter's profile and zones come as one row.
    Categories follow from the types, so they are found again after the moves."""
    ruled = {c: rule(of) for c, of, rule in (("pitch_category", "pitch_type", pitch_category), ("last_pitch_category", "last_pitch_type", pitch_category_or_null))
             if {c, of} <= set(pitches.columns)}
    df = join_pitcher_features(pitches.drop(*ruled), pitcher_prof, strict=strict)
    if zone_long is not None:
        both = batter_wide.join(batter_zones(zone_long), "batter", "full")
        # one row a batter already; said as an aggregate, the optimizer knows it and leaves
        # the join out where nobody reads its columns
        batter_wide = both.groupBy("batter").agg(*[F.first(c).alias(c) for c in both.columns if c != "batter"])
    df = join_batter_features(df, batter_wide).withColumns(ruled)
    df = add_location_features(df, zone_long)
    df = add_situational_features(df)
    df = add_interaction_features(df)
    feats = [c for c in ALL_FEATURES if c in df.columns]
    return df.select(*[c for c in ID_COLS if c in df.columns], *feats, "run_value")
