"""Within-at-bat sequence features and E14 outcome flags.

All windows share one spec (partition by at-bat, order by pitch) so Spark
plans a single sort per partition; the partition keys start with
``game_pk`` so a table already hash-partitioned by game needs no shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundflow import constants as K
from moundflow.functions.pitch import (is_contact, is_in_zone, is_swing, outcome_class,
                                       pitch_category, pitch_category_or_null)


def at_bat_window(df: DataFrame):
    keys = ["game_pk", "at_bat_number"] if all(c in df.columns for c in ["game_pk", "at_bat_number"]) \
        else ["game_pk", "pitcher", "batter"]
    order = [F.col(c).asc_nulls_last() for c in ["game_date", "at_bat_number", "pitch_number"] if c in df.columns]
    return keys, Window.partitionBy(*keys).orderBy(*order)


def add_sequence_features(df: DataFrame) -> DataFrame:
    keys, w = at_bat_window(df)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key_ok = None
    for k in keys:
        key_ok = F.col(k).isNotNull() if key_ok is None else (key_ok & F.col(k).isNotNull())

    def masked(c):
        return F.when(key_ok, c)

    df = df.withColumns({
        "last_pitch_type": masked(F.lag("pitch_type").over(w)),
        "last_pitch_result": masked(F.lag("description").over(w)),
        "last_pitch_speed": masked(F.lag("release_speed").over(w)),
        "last_pitch_zone": masked(F.lag("zone").over(w)),
        "pitch_num_in_ab": masked(F.row_number().over(w)),
        "pitch_category": pitch_category("pitch_type"),
    })
    cat = F.col("pitch_category")
    df = df.withColumns({
        "last_pitch_category": pitch_category_or_null("last_pitch_type"),
        "speed_delta": F.col("release_speed") - F.col("last_pitch_speed"),
        "last_pitch_in_zone": is_in_zone("last_pitch_zone"),
        **{f"{c}_count_in_ab": masked(F.sum((cat == c).cast("int")).over(running)) for c in K.CATEGORIES},
        "same_as_last": F.coalesce((F.col("pitch_type") == F.col("last_pitch_type")).cast("int"), F.lit(0)),
        # W8 gaps-and-islands without a second sort: a streak restarts where the
        # type changes; its length so far is position - start of the streak.
        "_streak_start": F.when(F.col("last_pitch_type").isNull()
                                | (F.col("pitch_type") != F.col("last_pitch_type"))
                                | F.col("pitch_type").isNull(), F.col("pitch_num_in_ab")),
    })
    df = df.withColumn("consecutive_same_pitch",
                       masked(F.col("pitch_num_in_ab") - F.max("_streak_start").over(running)))
    return df.drop("_streak_start")


def add_outcome_features(df: DataFrame) -> DataFrame:
    """Outcome class and the swing / zone / contact / whiff / chase flags."""
    sw, iz, ct = is_swing("description"), is_in_zone("zone"), is_contact("description")
    df = df.withColumn("outcome_class", outcome_class("description", "events"))
    return df.withColumns({
        "is_swing": sw,
        "is_in_zone": iz,
        "is_contact": ct,
        "is_whiff": sw & ~ct,
        "is_chase": sw & ~iz,
        "is_called_strike": F.col("outcome_class") == "called_strike",
    })


def add_extra_sequence(df: DataFrame) -> DataFrame:
    """W14 (design only in the reference): previous pitch swung at, and the
    share of fastballs seen so far in the at-bat (current pitch included)."""
    keys, w = at_bat_window(df)
    return df.withColumns({
        "last_pitch_swing": F.lag(is_swing("description")).over(w),
        "fastball_pct_this_ab": F.col("FB_count_in_ab") / F.col("pitch_num_in_ab"),
    })
