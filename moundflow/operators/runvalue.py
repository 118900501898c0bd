"""Run value of every pitch from the change in run expectancy
plus runs scored, and the older per-game variant."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundflow import constants as K
from moundflow.functions.pitch import _c, bases_state, clamp, literal_map

GAME_PARTITION = "game_pk"


def re_lookup(outs, bases) -> Column:
    """E3 / J6 with the built-in 24-state matrix as a literal map: no join,
    evaluated inside codegen.  Unknown state -> 0.0."""
    m = literal_map({f"{o}|{b}": v for (o, b), v in K.RUN_EXPECTANCY.items()})
    key = F.concat_ws("|", _c(outs).cast("int").cast("string"), _c(bases))
    return F.coalesce(F.try_element_at(m, key), F.lit(0.0))


def run_expectancy(outs, on_1b, on_2b, on_3b) -> Column:
    """Clamp outs to 0..2, look up the state, default 0.0."""
    o = clamp(F.coalesce(_c(outs).cast("int"), F.lit(0)), 0, 2)
    return re_lookup(o, bases_state(on_1b, on_2b, on_3b))


def _re_from_table(df: DataFrame, re_table: DataFrame, outs: str, bases: str, out: str) -> DataFrame:
    """J6 with a user-supplied run-expectancy table (24 states: broadcast)."""
    t = re_table.select(F.col("outs").cast("int").alias("_o"), F.col("bases_state").alias("_b"),
                        F.col("run_expectancy").cast("double").alias(out))
    j = df.join(F.broadcast(t), (F.col(outs).cast("int") == F.col("_o")) & (F.col(bases) == F.col("_b")), "left")
    return j.drop("_o", "_b").withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def half_inning_window(df: DataFrame):
    keys = ["game_pk", "inning", "inning_topbot"] if all(
        c in df.columns for c in ["game_pk", "inning", "inning_topbot"]) else ["game_pk"]
    order = [F.col(c).asc_nulls_last() for c in ["game_date", "at_bat_number", "pitch_number"] if c in df.columns]
    return keys, Window.partitionBy(*keys).orderBy(*order)


def runs_on_play(df: DataFrame) -> Column:
    """Score change on the pitch, with the reference's fallback chain
    chosen at plan time from the columns present."""
    cols = set(df.columns)
    if {"post_bat_score", "bat_score"} <= cols:
        return F.coalesce((F.col("post_bat_score") - F.col("bat_score")).cast("double"), F.lit(0.0))
    if {"post_fld_score", "fld_score"} <= cols:
        return F.coalesce((F.col("post_fld_score") - F.col("fld_score")).cast("double"), F.lit(0.0))
    if "events" in cols:
        ev = F.lower(F.col("events"))
        return F.when(F.coalesce(ev.contains("home_run") | ev.contains("sac_fly"), F.lit(False)), 1.0).otherwise(0.0)
    return F.lit(0.0)


def add_run_values(df: DataFrame, re_table: DataFrame | None = None) -> DataFrame:
    """run_value = re_after - re_before + runs_on_play.

    ``re_after`` is the next pitch's state in the same half-inning (lead);
    0 when there is no next pitch, when 2 outs are followed by 0 outs, or at
    3+ outs.  The window partitions by game (a subset of its keys), so one
    hash shuffle on ``game_pk`` serves this and the at-bat windows.
    """
    df = df.withColumns({
        "bases_state": bases_state("on_1b", "on_2b", "on_3b"),
        "outs": clamp(F.coalesce(F.col("outs_when_up").cast("int"), F.lit(0)), 0, 2),
    })
    keys, w = half_inning_window(df)
    key_ok = None
    for k in keys:
        key_ok = F.col(k).isNotNull() if key_ok is None else (key_ok & F.col(k).isNotNull())
    df = df.withColumns({
        "_next_outs": F.when(key_ok, F.lead("outs").over(w)),
        "_next_bases": F.when(key_ok, F.lead("bases_state").over(w)),
    })
    ended = F.col("_next_outs").isNull() | ((F.col("outs") == 2) & (F.col("_next_outs") == 0)) | (F.col("_next_outs") >= 3)
    if re_table is None:
        df = df.withColumn("re_before", re_lookup(F.col("outs"), F.col("bases_state")))
        after = re_lookup(F.col("_next_outs"), F.col("_next_bases"))
        df = df.withColumn("re_after", F.when(ended | F.col("_next_bases").isNull(), F.lit(0.0)).otherwise(after))
    else:
        df = _re_from_table(df, re_table, "outs", "bases_state", "re_before")
        df = _re_from_table(df, re_table, "_next_outs", "_next_bases", "_re_next")
        df = df.withColumn("re_after", F.when(ended | F.col("_next_bases").isNull(), F.lit(0.0)).otherwise(F.col("_re_next")))
        df = df.drop("_re_next")
    df = df.withColumn("runs_on_play", runs_on_play(df))
    df = df.withColumn("run_value", F.col("re_after") - F.col("re_before") + F.col("runs_on_play"))
    return df.drop("_next_outs", "_next_bases")


def add_run_values_per_game(df: DataFrame, runs_col: str = "runs_scored") -> DataFrame:
    """Older run value — before-state RE (raw outs, no clamp) led by one
    pitch within the game, last pitch of a game -> 0, plus runs scored.
    The original led across the whole file; a file-wide lead would need a
    single partition, so the lead is per game (documented difference)."""
    before = re_lookup(F.col("outs_when_up"), bases_state("on_1b", "on_2b", "on_3b"))
    w = Window.partitionBy("game_pk").orderBy(*[F.col(c).asc_nulls_last() for c in ["game_date", "at_bat_number", "pitch_number"]])
    runs = F.col(runs_col).cast("double") if runs_col in df.columns else runs_on_play(df)
    df = df.withColumn("before_state", before)
    df = df.withColumn("after_state", F.coalesce(F.lead("before_state").over(w), F.lit(0.0)))
    return df.withColumn("run_value_v0", F.col("after_state") - F.col("before_state") + runs)
