"""Registry of checkable queries: Spark plan + oracle SQL + output spec.

Each query reads the driver's tables through ``Tables`` (the pitch view is
derived from ``lineitem`` and ``orders`` in full), so its work grows with
the input.
"""
from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from moundflow.operators import analytics as AN
from moundflow.plans import oracle
from moundflow.plans.tables import Tables
from moundflow.plans.spec import finalize_df, finalize_sql
from moundflow.session import written


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    spec: str
    source: str | None = None          # final CTE name in the oracle
    ctes: tuple = ()
    sql: str | None = None             # full oracle SQL when not from a CTE
    keep: tuple = ()                   # tables written once because the plan reads them several times

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        for name in self.keep:
            t.materialize(name)
        return finalize_df(self.build(t), self.spec)

    def oracle(self) -> str | None:
        if self.sql is not None:
            return self.sql
        if self.source is None:
            return None
        return oracle.with_ctes(finalize_sql(self.source, self.spec), [self.source, *self.ctes])


KEY = "game_pk:i at_bat_number:i pitch_number:i"
REGISTRY: dict[str, Query] = {}


def register(q: Query) -> None:
    REGISTRY[q.name] = q


register(Query(
    "c04_clean_pitches", lambda t: t.clean,
    f"src_key:i {KEY} game_date:d pitcher:i batter:i pitch_type:s description:s events:s "
    "inning:i inning_topbot:s outs_when_up:i on_1b:i on_2b:i on_3b:i zone:i balls:i strikes:i "
    "stand:s p_throws:s release_speed:f plate_x:f plate_z:f",
    source="clean"))

register(Query(
    "w02_run_value", lambda t: t.pitches_with(),
    f"{KEY} bases_state:s outs:i re_before:f re_after:f runs_on_play:f run_value:f",
    source="seq"))

register(Query(
    "w04_sequence_features", lambda t: t.pitches_with(),
    f"{KEY} last_pitch_type:s last_pitch_category:s last_pitch_result:s last_pitch_speed:f speed_delta:f "
    "last_pitch_zone:i last_pitch_in_zone:b pitch_num_in_ab:i pitch_category:s FB_count_in_ab:i "
    "BR_count_in_ab:i OS_count_in_ab:i same_as_last:i consecutive_same_pitch:i",
    source="seq"))

register(Query(
    "e14_outcome_flags", lambda t: t.pitches_with(),
    f"{KEY} outcome_class:s is_swing:b is_in_zone:b is_contact:b is_whiff:b is_chase:b is_called_strike:b",
    source="seq"))

register(Query(
    "a01_batter_category_counts", lambda t: t.batter_counts,
    "batter:i pitch_category:s total_pitches:i swings:i whiffs:i out_of_zone:i chases:i zone_swings:i "
    "zone_contact:i batted_balls:i groundballs:i xwoba_sum:f xwoba_count:i",
    source="bcounts"))

register(Query(
    "a02_batter_profiles", lambda t: t.batter_profiles,
    "batter:i pitch_category:s total_pitches:i swings:i whiff_rate:f chase_rate:f zone_contact_rate:f "
    "gb_rate:f xwoba:f vulnerability_score:f whiff_rate_raw:f chase_rate_raw:f zone_contact_rate_raw:f",
    source="bprof"))

_WIDE = " ".join(f"{s}_vs_{c}:{'i' if s == 'total_pitches' else 'f'}"
                 for s in ["whiff_rate", "chase_rate", "zone_contact_rate", "gb_rate", "xwoba",
                           "vulnerability_score", "total_pitches"] for c in ["FB", "BR", "OS"])
register(Query("a03_batter_profiles_wide", lambda t: t.batter_wide, f"batter:i {_WIDE}", source="bwide"))

register(Query(
    "a04_pitcher_profiles", lambda t: t.pitcher_profiles,
    "pitcher:i p_throws:s pitch_type:s total_pitches:i avg_velo:f std_velo:f avg_spin:f avg_pfx_x:f "
    "avg_pfx_z:f swings:i whiffs:i strikes:i avg_plate_x:f avg_plate_z:f whiff_rate:f strike_rate:f "
    "pitch_category:s usage_rate:f fb_velo:f velo_diff_from_fb:f",
    source="pprof"))

register(Query(
    "a07_pitcher_arsenals", lambda t: t.pitcher_arsenals,
    "pitcher:i p_throws:s num_pitch_types:i pitch_types:s primary_fb:s fb_velo:f best_secondary:s "
    "best_secondary_whiff:f",
    source="pars"))

register(Query(
    "a08_league_zone_stats", lambda t: t.league_zones,
    "zone:i lg_whiff_rate:f lg_contact_rate:f lg_swing_rate:f lg_xwoba:f",
    source="zlg"))

register(Query(
    "a09_batter_zone_profiles", lambda t: t.zone_long,
    "batter:i zone:i whiff_rate:f contact_rate:f swing_rate:f xwoba:f pitches:i chase_rate_overall:f",
    source="zlong"))

_ZW = " ".join(f"zone_{z}_{s}:{'i' if s == 'pitches' else 'f'}" for z in range(1, 15)
               for s in ["whiff_rate", "contact_rate", "swing_rate", "xwoba", "pitches"])
register(Query("a10_batter_zone_wide", lambda t: t.zone_wide, f"batter:i {_ZW} chase_rate_overall:f",
               source="zwide"))


def _features_spec() -> str:
    from moundflow.operators import features as FE
    ints = set(FE.COUNT_FEATURES + FE.SITUATION_FEATURES + FE.MATCHUP_FEATURES
               + ["pitch_num_in_ab", "same_as_last", "consecutive_same_pitch", "zone", "in_zone"])
    parts = ["game_pk:i", "game_date:d", "pitcher:i", "batter:i", "at_bat_number:i", "pitch_number:i"]
    for c in FE.ALL_FEATURES:
        kind = "s" if c in FE.CATEGORICAL_FEATURES else ("i" if c in ints else "f")
        parts.append(f"{c}:{kind}")
    parts.append("run_value:f")
    return " ".join(parts)


register(Query("f09_features", lambda t: t.whole_features, _features_spec(), source="features", keep=("raw",)))

register(Query("a12_distinct_arsenal", lambda t: AN.distinct_arsenal(t.raw), "pitcher:i pitch_type:s",
               source="arsenal12"))
register(Query(
    "a13_batter_pitchtype_matchup", lambda t: AN.matchup_stats(t.pitches_with("p_throws", "woba_value")),
    "batter:i pitch_type:s p_throws:s batter_pitchtype_woba:f batter_pitchtype_whiff_rate:f "
    "batter_pitchtype_run_value:f n:i", source="matchup"))
register(Query("a14_top_pitch_types", lambda t: AN.top_pitch_types(AN.distinct_arsenal(t.raw)),
               "rank:i pitch_type:s pitchers:i", source="top3"))
register(Query(
    "a15_dataset_summary", lambda t: AN.dataset_summary(t.pitches_with()),
    "pitches:i pitchers:i batters:i first_date:d last_date:d rv_count:i rv_mean:f rv_std:f rv_min:f "
    "rv_p25:f rv_p50:f rv_p75:f rv_max:f", source="summary"))
register(Query("a16_run_value_stats", lambda t: AN.run_value_stats(t.pitches_with()),
               "rv_mean:f rv_std:f runs_total:f scoring_plays:i", source="rvstats"))
register(Query("a17_rv_by_location", lambda t: AN.rv_by_location(t.features),
               "loc_horizontal:s loc_vertical:s level:i mean_rv:f pitches:i", source="rvloc"))
register(Query("a18_best_worst_location", lambda t: AN.best_worst_location(t.features),
               "pitch_type:s best_location:s best_rv:f worst_location:s worst_rv:f", source="bestloc"))
register(Query("a19_baseline_table", lambda t: AN.baseline_table(t.pitches_with("balls", "strikes", "p_throws", "stand")),
               "count:s pitch_type:s zone:s p_throws:s stand:s level:i rv:f n:i", source="baseline"))


def _kept_pitches(t: Tables, *columns: str) -> DataFrame:
    """The pitches' columns that several parts of a plan read, written once."""
    return written(t.pitches_with("balls", "strikes", "p_throws", "stand").select("pitch_type", "zone", "balls", "strikes", "p_throws", "stand", "run_value", *columns), "pitches")


def _backoff(t: Tables):
    p = _kept_pitches(t, "game_pk", "at_bat_number", "pitch_number")
    return AN.baseline_lookup(p.withColumn("count", AN.count_text()), AN.baseline_table(p))


register(Query("j08_baseline_backoff", _backoff, f"{KEY} baseline_rv:f baseline_level:s", source="backoff"))
register(Query("a20_outcome_run_values", lambda t: AN.outcome_rv_table(t.pitches_with("balls", "strikes")),
               "outcome:s count:s rv:f n:i", source="outcome_rv"))
register(Query("a21_outcome_distribution", lambda t: AN.outcome_distribution(t.pitches_with("balls", "strikes")),
               "count:s pitch_type:s outcome:s n:i p:f", source="outcome_dist"))

# --- recommendations, heuristic, count rules, EPRV ---------------------------
from pyspark.sql import functions as F  # noqa: E402

from moundflow.functions.pitch import count_adjusted_re, count_delta, parse_count  # noqa: E402
from moundflow.operators import heuristic as HE  # noqa: E402
from moundflow.operators import recommend as RE  # noqa: E402
from moundflow.operators.runvalue import run_expectancy  # noqa: E402
from moundflow.sources import requests as RQ  # noqa: E402


def _requests(t: Tables):
    return RQ.requests(t.spark, t.sf_dir)


def _archetypes(t: Tables):
    return RQ.archetypes(t.spark, t.raw.select("batter"))


def _recommend(t: Tables):
    return RE.recommend(_requests(t), t.pitcher_arsenals, t.pitcher_profiles, t.batter_wide, t.zone_long)


register(Query(
    "r05_recommend", _recommend,
    "request_id:i rank:i pitch_type:s category:s predicted_rv:f expected_re_after:f probability:f "
    "probability_pct:f batter_whiff_rate:f batter_chase_rate:f batter_xwoba:f reasoning:s loc_plate_x:f "
    "loc_plate_z:f loc_zone:i loc_in_zone:b loc_expected_rv:f location_label:s", source="recommend", keep=("raw",)))


def _legacy(t: Tables):
    """The pitch -> run value map as text, values in millionths."""
    entry = lambda e: F.concat(e["key"], F.lit(":"), F.floor(e["value"] * 1000000.0 + 0.501).cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("predictions")), entry), ",")
    return RE.legacy_summary(_recommend(t)).withColumn("predictions", text)


register(Query("r09_legacy_summary", _legacy, "request_id:i best_pitch:s best_rv:f options:i predictions:s", source="legacy"))
register(Query(
    "r10_heuristic_candidates",
    lambda t: HE.next_pitch_candidates(_requests(t), _archetypes(t), AN.distinct_arsenal(t.raw), "batter_query"),
    "request_id:i rank:i pitch:s pct:f location:s score:f archetype:s expected_after_re:f is_top:b",
    source="hcand", keep=("raw",)))
register(Query(
    "r11_heuristic_sequence",
    lambda t: HE.recommend_sequence(_requests(t), _archetypes(t), AN.distinct_arsenal(t.raw), key="batter_query"),
    "request_id:i batter_archetype:s seq_1:s seq_2:s seq_3:s loc_1:s loc_2:s loc_3:s confidence:f strategy_notes:s",
    source="hseq", keep=("raw",)))


def _count_re(t: Tables):
    r = _requests(t)
    bc, sc = parse_count("count_text", True)
    bu, su = parse_count("count_text", False)
    r = r.withColumns({"balls_clamped": bc, "strikes_clamped": sc, "_bu": bu, "_su": su,
                       "base_re": run_expectancy("outs", "on_1b", "on_2b", "on_3b")})
    return r.withColumn("current_re", count_adjusted_re("base_re", "_bu", "_su"))


register(Query("e20_count_adjusted_re", _count_re,
               "request_id:i count_text:s balls_clamped:i strikes_clamped:i base_re:f current_re:f", source="countre"))
register(Query(
    "e04_count_delta",
    lambda t: t.pitches_with("balls", "strikes").withColumn("count_delta", count_delta("balls", "strikes", "outcome_class")),
    f"{KEY} outcome_class:s count_delta:f", source="countdelta"))


def _eprv_choice(t: Tables):
    """R12 for every request.  What a request asks is one of few contexts, and what a
    pitch is worth there is one of few cells (count, pitch type, hand, stance: the
    game's, whatever the rows).  The nine zones are judged once per cell, the
    pitcher's pitches once per context, and a request takes its context's choice."""
    context, cell = ["pitcher", "stand", "count", "_unseen"], ["count", "pitch_type", "p_throws", "stand", "_unseen"]
    # some requests ask for a pitch nobody threw: they take the count's distribution
    r = _requests(t).select("request_id", "pitcher", "stand", AN.count_text().alias("count"), F.coalesce(F.col("request_id") % 13 == 0, F.lit(False)).alias("_unseen"))
    a = AN.distinct_arsenal(t.raw)
    hands = t.pitcher_arsenals.select("pitcher", F.col("p_throws").alias("_hand"))
    asked = written(r.select(*context).distinct().join(a, "pitcher", "inner").join(hands, "pitcher", "left")
                    .withColumn("p_throws", F.coalesce("_hand", F.lit("R"))).drop("_hand"), "asked")
    p = _kept_pitches(t, "description", "events")
    dist, rv = AN.outcome_distribution(p), AN.outcome_rv_table(p)
    c = asked.select(*cell).distinct().withColumn("_cell_type", F.col("pitch_type")).withColumn("zone", F.explode(F.sequence(F.lit(1), F.lit(9))))
    c = c.withColumn("pitch_type", F.when(F.col("_unseen") & (F.col("zone") == 1), F.lit("KN")).otherwise(F.col("pitch_type")))
    judged = AN.eprv_candidates(c, AN.eprv_by_context(dist, rv), AN.baseline_table(p), AN.eprv_by_context(AN.count_distribution(dist), rv))
    of_cell = AN.choose_eprv(judged, *[c if c != "pitch_type" else "_cell_type" for c in cell]).withColumnRenamed("_cell_type", "pitch_type")
    # the cells are bounded by the game; the contexts are not, but a written table of them is
    # a few compressed bytes a row, so by its files' size it would be the one that is broadcast
    of_context = AN.best_choice(_same(asked, F.broadcast(of_cell), cell), *context)
    return AN.best_choice(_same(r, of_context, context), "request_id")


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """An inner join by names, in which null equals null."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in names})
    return left.join(other, functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names])).drop(*[f"_r_{c}" for c in names])


register(Query("r12_eprv_rvaa", _eprv_choice,
               "request_id:i best_pitch:s best_zone:i raw_eprv:f baseline_rv:f rvaa:f candidates:i",
               source="eprv_best", keep=("raw",)))


def _matchup_lookup(t: Tables):
    r = _requests(t).select("request_id", "pitcher", "batter")
    hands = t.pitcher_arsenals.select("pitcher", F.col("p_throws").alias("_hand"))
    k = (r.join(AN.distinct_arsenal(t.raw), "pitcher", "inner").join(hands, "pitcher", "left")
         .withColumn("p_throws", F.coalesce("_hand", F.lit("R"))).drop("_hand"))
    return AN.matchup_lookup(k, AN.matchup_stats(t.pitches_with("p_throws", "woba_value")))


register(Query("j13_matchup_lookup", _matchup_lookup,
               "request_id:i pitch_type:s p_throws:s batter_pitchtype_woba:f batter_pitchtype_whiff_rate:f "
               "batter_pitchtype_run_value:f", source="mlookup"))

# --- ML path -----------------------------------------------------------------
from moundflow.operators import model as ML  # noqa: E402


def _timed(t: Tables, *columns: str):
    """Feature rows that have a run value: what the order in time and a query read."""
    return t.features.filter(F.col("run_value").isNotNull()).select(*ML.ORDER, *columns)


def _split_no_model(t: Tables):
    s = ML.time_split(_timed(t, "run_value", "batter_whiff_rate_vs_this_cat"))
    return s.withColumn("prediction", RE.no_model_rv(s))


register(Query("w10_time_split", lambda t: ML.time_split(_timed(t)), f"{KEY} time_rank:i split:s", source="w10"))
register(Query("a22_regression_metrics", lambda t: ML.regression_metrics(_split_no_model(t)),
               "split:s n:i mse:f rmse:f mae:f r2:f explained_variance:f", source="a22"))
register(Query("a23_ranking_quality",
               lambda t: ML.ranking_quality(_split_no_model(t).filter(F.col("split") == "test")),
               "pct_better_than_avg:f avg_rv_improvement:f at_bats:i", source="a23"))


def _calibration(t: Tables):
    p = t.pitcher_profiles.select("pitcher", "p_throws", "pitch_type", F.col("whiff_rate").alias("p_whiff"))
    j = t.pitches_with("p_throws").join(p, ["pitcher", "p_throws", "pitch_type"], "inner")
    return AN.calibration(j, "p_whiff", "is_whiff").withColumnRenamed("bin", "bin")


register(Query("a26_calibration", _calibration, "bin:i mean_predicted:f observed_rate:f n:i", source="a26"))


_FITS: dict[tuple[str, str], tuple] = {}


def _trained(t: Tables):
    """(model, split rows) of an input folder.  A fit is repeatable, so the three
    queries that need the model share one per session; its rows are a checkpoint
    in the shared folder, nothing stays in executors' memory."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _FITS:
        model, _, _, df = ML.train(t.whole_features)
        _FITS[key] = (model, df)
    return _FITS[key]


def _gbt_metrics(t: Tables):
    model, df = _trained(t)
    return ML.regression_metrics(ML.predict(model, df, "prediction"))


def _gbt_importance(t: Tables):
    model, df = _trained(t)
    return ML.feature_importance(model, model.transform(df))


def _recommend_with_model(t: Tables):
    return RE.recommend(_requests(t), t.pitcher_arsenals, t.pitcher_profiles, t.batter_wide, t.zone_long,
                        model=_trained(t)[0], top_n=None, optimize_location=True)


register(Query("m03_gbt_metrics", _gbt_metrics, "split:s n:i mse:f rmse:f mae:f r2:f explained_variance:f"))
register(Query("m06_feature_importance", _gbt_importance, "feature:s importance:f"))
register(Query(
    "r06_recommend_with_model", _recommend_with_model,
    "request_id:i rank:i pitch_type:s category:s predicted_rv:f expected_re_after:f probability:f "
    "reasoning:s loc_plate_x:f loc_plate_z:f loc_zone:i loc_in_zone:b loc_expected_rv:f location_label:s",
    keep=("raw", "batter_wide", "pitcher_profiles", "zone_long")))

# --- at-bat state fold -------------------------------------------------------
from moundflow.streaming import atbat as AB  # noqa: E402


def _trace(t: Tables):
    return AB.atbat_trace(RQ.atbat_log(t.spark, t.sf_dir))


register(Query(
    "t01_atbat_fold", _trace,
    "session_id:i seq:i pitch:s outcome:s count_before:s count_after:s outs_after:i on_1b:b on_2b:b on_3b:b "
    "at_bat_ended:b at_bat_active:b", source="trace"))
register(Query(
    "s09_atbat_summary", lambda t: AB.atbat_summary(_trace(t)),
    "session_id:i n_pitches:i count:s outs:i on_1b:b on_2b:b on_3b:b atbat_active:b at_bats_ended:i",
    source="atsum"))

# --- older run value, extra sequence columns, rule locations, search, union --
from moundflow.functions.location import rule_avoid, rule_based_location  # noqa: E402
from moundflow.operators import runvalue as RV  # noqa: E402
from moundflow.operators import sequence as SQ  # noqa: E402


def _rv_old(t: Tables):
    df = t.clean.withColumn("runs_scored", RV.runs_on_play(t.clean))
    return RV.add_run_values_per_game(df.repartition("game_pk"))


register(Query("w09_run_value_per_game", _rv_old, f"{KEY} before_state:f after_state:f run_value_v0:f",
               source="rv_old"))
register(Query("w14_extra_sequence", lambda t: SQ.add_extra_sequence(t.pitches_with()),
               f"{KEY} last_pitch_swing:b fastball_pct_this_ab:f", source="seq_extra"))
register(Query(
    "e26_rule_based_location",
    lambda t: t.pitches_with("stand").withColumns({"rule_location": rule_based_location("pitch_type", "stand"), "rule_avoid": rule_avoid("pitch_type")})
    .groupBy("rule_location", "rule_avoid", "pitch_type").agg(F.count(F.lit(1)).alias("pitches"), F.avg("run_value").alias("mean_rv")),
    "rule_location:s rule_avoid:s pitch_type:s pitches:i mean_rv:f", source="rule_loc"))
register(Query(
    "e27_text_search",
    lambda t: AN.text_search(t.raw, "home_run", ["inning_topbot", "p_throws", "stand", "pitch_type", "description",
                                                  "events"]).groupBy("pitcher").agg(F.count(F.lit(1)).alias("pitches")),
    "pitcher:i pitches:i", source="search"))


def _seasons(t: Tables):
    d = F.col("game_date")
    early = t.raw.filter(d < F.lit("2024-06-01").cast("date"))
    late = t.raw.filter((d >= F.lit("2024-06-01").cast("date")) | d.isNull())
    return AN.union_stats(AN.season_union(early, late), pitcher_id=7)


register(Query("s10_season_union", _seasons, "pitches:i pitchers:i batters:i pitcher_pitches:i", source="seasons"))
register(Query("a24_unique_batters", lambda t: AN.unique_players(t.raw, "batter"), "batter:i", source="players"))


def _decision_quality(t: Tables):
    """The model's place in the policies is that of a stand-in scorer SQL knows, too."""
    f = written(t.whole_features.select("game_pk", "at_bat_number", "pitch_number", "batter", "pitch_type", "stand", "in_zone", "loc_horizontal", "loc_vertical", "run_value"), "features")
    pitch = F.struct("game_pk", "at_bat_number", "pitch_number")
    c = f.select(pitch.alias("request_id"), F.lit(0).alias("arsenal_pos"), "batter", "pitch_type")
    best = RE.optimize_locations(c, t.zone_long, carry=["pitch_type"], scorer=_stand_in()).select("request_id.*", "location.plate_x", "location.plate_z")
    return AN.decision_quality(f, modelled=AN.modelled_cells(best))


register(Query("a25_decision_quality", _decision_quality, "policy:s mean_rv:f se_rv:f strike_share:f n:i", source="dq"))

# --- text input, reports, clipping, exposure, geometry, names, location grid ---
from moundflow.functions import location as LOC  # noqa: E402
from moundflow.operators import clean as CL  # noqa: E402
from moundflow.sources import files as FI  # noqa: E402


def _as_text(t: Tables):
    """The raw log as text with values that do not parse."""
    bad = F.col("src_key") % 7 == 0
    text = {c: F.when(bad, F.lit("n/a")).otherwise(F.col(c).cast("string")) for c in ("release_speed", "plate_x", "zone", "balls", "game_date")}
    return CL.coerce_types(t.raw.withColumns(text))


register(Query("c02_coerced_text", _as_text, "src_key:i release_speed:f plate_x:f zone:f balls:f game_date:d", source="coerced"))
register(Query("c08_cleaning_report", lambda t: CL.cleaning_report(t.raw), "rows_before:i rows_complete:i rows_after:i rows_dropped:i", source="creport"))
register(Query("c09_clipped", lambda t: CL.clip_columns(t.raw, {"release_speed": (70.0, 95.0), "plate_x": (-1.0, 1.0), "plate_z": (1.0, 4.0)}),
               "src_key:i release_speed:f plate_x:f plate_z:f", source="clipped"))
register(Query("c10_min_exposure", lambda t: CL.min_exposure(t.batter_counts, "total_pitches", 50),
               "batter:i pitch_category:s total_pitches:i", source="exposed"))
register(Query(
    "e16_location_rules",
    lambda t: t.clean.select(*CL.PITCH_KEY, LOC.coords_to_zone("plate_x", "plate_z").alias("zone_of_coords"),
                             LOC.loc_horizontal_scoring("plate_x").alias("h_scoring"), LOC.loc_vertical_scoring("plate_z").alias("v_scoring"),
                             LOC.location_label("plate_x", "plate_z").alias("label")),
    f"{KEY} zone_of_coords:i h_scoring:s v_scoring:s label:s", source="locrules"))
register(Query(
    "s06_re_table_join",
    lambda t: t.pitches_with().groupBy("outs", "bases_state").agg(F.count(F.lit(1)).alias("pitches")).join(
        FI.run_expectancy_table(t.spark), ["outs", "bases_state"], "left"),
    "outs:i bases_state:s pitches:i run_expectancy:f", source="retable"))


def _resolved(t: Tables):
    """Requests by customer name, some of them unknown, to ids: the last
    customer of a name wins (every tenth shares its name with the one before)."""
    shared = F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))
    names = FI.names_of(t.table("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Customer "), shared.cast("string")).alias("name"),
                                                   F.col("c_custkey").alias("line")), "line")
    asked = t.table("orders").select(F.col("o_orderkey").alias("request_id"),
                                     F.concat(F.when(F.col("o_orderkey") % 8 == 0, "Nobody ").otherwise("Customer "), F.col("o_custkey").cast("string")).alias("who"))
    return FI.resolve_names(asked, names, "who", "player_id")


register(Query("j11_resolved_names", _resolved, "request_id:i who:s player_id:i player_id_resolved:b", source="resolved"))


def _stand_in():
    """A scorer that depends on the place."""
    return (F.col("batter_whiff_rate_at_zone") * F.lit(-0.2) + F.col("batter_xwoba_at_zone") * F.lit(0.1)
            + F.abs(F.col("plate_x")) * F.lit(0.01) + F.when(F.col("loc_vertical") == "mid_low", 0.004).otherwise(0.0))


def _grid(t: Tables):
    """R6's 25 cells per candidate with a scorer that depends on the place."""
    c = RE.resolve_arsenal(_requests(t).select("request_id", "pitcher", "batter"), t.pitcher_arsenals, t.pitcher_profiles)
    best = RE.optimize_locations(c, t.zone_long, carry=["pitch_type"], scorer=_stand_in())
    return best.select("request_id", "arsenal_pos", "pitch_type", "location.*")


register(Query("r06_location_grid", _grid,
               "request_id:i arsenal_pos:i pitch_type:s plate_x:f plate_z:f zone:i in_zone:i expected_rv:f", source="grid"))


# --- untidy files, search over all columns ------------------------------------------
import uuid  # noqa: E402

from moundflow.session import ensure_checkpoint_dir  # noqa: E402
from moundflow.sources.untidy import write_untidy  # noqa: E402


def _tolerant(t: Tables):
    folder = f"{ensure_checkpoint_dir(t.spark)}/untidy-{uuid.uuid4().hex}"
    write_untidy(t.raw, folder)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("src_key", T.LongType()), T.StructField("pitcher", T.LongType()),
                           T.StructField("pitch_type", T.StringType()), T.StructField("speed", T.DoubleType())])
    return FI.read_tolerant_csv(t.spark, [f"{folder}/absent.csv", folder], schema)


register(Query("s02_tolerant_csv", _tolerant, "src_key:i pitcher:i pitch_type:s speed:f", source="untidy"))
register(Query(
    "e27_search_numbers_and_text",
    lambda t: AN.text_search(t.raw.select("src_key", "game_pk", "pitcher", "batter", "zone", "description", "events"), "12")
    .groupBy("pitcher").agg(F.count(F.lit(1)).alias("pitches")),
    "pitcher:i pitches:i", source="search12"))


def _trace_stream(t: Tables):
    return AB.replay(RQ.atbat_log(t.spark, t.sf_dir), f"{ensure_checkpoint_dir(t.spark)}/atbat-{uuid.uuid4().hex}")


register(Query(
    "t02_atbat_stream", _trace_stream,
    "session_id:i seq:i pitch:s outcome:s count_before:s count_after:s outs_after:i on_1b:b on_2b:b on_3b:b "
    "at_bat_ended:b at_bat_active:b", source="trace"))


def _documents(t: Tables):
    """The exported documents, parsed, a row for each entry of a history."""
    path = AB.write_documents(RQ.atbat_log(t.spark, t.sf_dir), f"{ensure_checkpoint_dir(t.spark)}/documents-{uuid.uuid4().hex}")
    docs = AB.read_documents(t.spark, path)
    return docs.select("session_id", "count", "situation.*", "n_pitches", "atbat_active", F.posexplode("history").alias("pos", "h")).select(
        "*", (F.col("pos") + 1).alias("place"), "h.seq", "h.pitch", "h.outcome", "h.count_before")


register(Query(
    "s09_atbat_export", _documents,
    "session_id:i count:s outs:i on_1b:b on_2b:b on_3b:b n_pitches:i atbat_active:b place:i seq:i pitch:s outcome:s count_before:s",
    source="atdocs"))


def _preprocessing(t: Tables):
    df, numeric, categorical, _ = ML.split_rows(t.whole_features)
    tr = df.filter(F.col("split") == "train")
    return ML.preprocessing_summary(ML.fit_preprocessing(tr, numeric, categorical), tr)


register(Query("m02_preprocessing", _preprocessing, "feature:s kind:s median:f mean:f std:f levels:s", source="m02"))


def _stored_seasons(t: Tables):
    """Summaries of two seasons, stored apart, then merged: together and by season."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/seasons-{uuid.uuid4().hex}"
    rows = t.raw.withColumn("season", F.when(F.col("game_date") < F.lit("2024-06-01").cast("date"), "early").otherwise("late"))
    for season in ("early", "late"):
        AN.season_summary(rows.where(F.col("season") == season)).write.parquet(f"{folder}/season={season}")
    stored = t.spark.read.parquet(folder)
    return AN.merge_seasons(stored).unionByName(AN.merge_seasons(stored, F.col("season")))


register(Query("s10_stored_seasons", _stored_seasons, "seasons:s pitches:i pitchers:i batters:i", source="stored"))


def _shift_importance(t: Tables):
    """The no-model score's inputs, and two columns it does not read."""
    read = ["batter_whiff_rate_vs_this_cat", "batter_xwoba_vs_this_cat", "count_balls"]
    return ML.permutation_importance(ML.time_ordinal(_timed(t, "run_value", *read)), read,
                                     lambda d: d.withColumn("prediction", RE.no_model_rv(d)))


register(Query("m06_shift_importance", _shift_importance, "feature:s mse_base:f mse_shifted:f importance:f", source="shifted", keep=("raw",)))


def _gbt_shift_importance(t: Tables):
    """The same of the fitted trees, for every feature, on the test rows."""
    model, df = _trained(t)
    test = df.filter(F.col("split") == "test").drop("split", "time_rank")
    return ML.model_importance(model, ML.time_ordinal(test))


register(Query("m06_gbt_shift_importance", _gbt_shift_importance, "feature:s mse_base:f mse_shifted:f importance:f"))
register(Query("m09_rolling_validation", lambda t: ML.rolling_validation(t.whole_features, n_folds=4, max_iter=20, max_depth=5),
               "split:s n:i mse:f rmse:f mae:f r2:f explained_variance:f", keep=("raw",)))

register(Query("r13_degraded_candidates", lambda t: HE.degraded_candidates(_requests(t), AN.distinct_arsenal(t.raw)),
               "request_id:i rank:i pitch:s pct:f location:s expected_after_re:f", source="degraded"))
register(Query("r15_model_table", lambda t: RE.model_table(_recommend(t)),
               "request_id:i place:i pitch_type:s expected_run_value:f expected_after_re:f", source="modeltable", keep=("raw",)))
_R4 = ("count_balls count_strikes is_ahead_in_count is_behind_in_count is_two_strikes is_three_balls is_full_count is_first_pitch outs is_two_outs "
       "runners_on risp bases_empty bases_loaded inning_num is_late_inning score_diff is_close_game same_as_last consecutive_same_pitch").split()


def _candidate_rows(t: Tables):
    c = RE.resolve_arsenal(_requests(t), t.pitcher_arsenals, t.pitcher_profiles)
    return RE.candidate_features(RE.attach_pitcher(RE.attach_batter(c, t.batter_wide), t.pitcher_profiles))


register(Query("r04_candidate_features", _candidate_rows,
               "request_id:i arsenal_pos:i pitch_type:s pitch_category:s last_pitch_category:s batter_whiff_rate_vs_this_cat:f "
               "chase_opportunity:f two_strike_whiff_boost:f " + " ".join(f"{c}:i" for c in _R4), source="candfeat", keep=("raw",)))


# --- what is written and read back -----------------------------------------------------
def _folder(t: Tables, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _read_logs(t: Tables):
    """The log as two folders of CSV files: other columns, in another order."""
    folder = _folder(t, "logs")
    cols = ["game_pk", "game_date", "pitcher", "batter", "at_bat_number", "pitch_number", "zone", "description", "release_speed", "plate_x"]
    even = F.col("src_key") % 2 == 0
    t.raw.where(even).select(*cols).write.option("header", True).csv(f"{folder}/a")
    t.raw.where(~even).select("src_key", *reversed(cols)).write.option("header", True).csv(f"{folder}/b")
    return FI.read_pitch_log(t.spark, folder)


register(Query("s01_read_logs", _read_logs,
               "game_pk:i game_date:d pitcher:i batter:i at_bat_number:i pitch_number:i zone:f description:s release_speed:f plate_x:f", source="raw"))


def _pitch_table(t: Tables):
    folder = _folder(t, "pitch-table")
    FI.write_pitch_table(t.pitches_with().select("game_pk", "game_date", "at_bat_number", "pitch_number", "pitch_type", "run_value"), folder)
    return t.spark.read.parquet(folder).where(F.col("game_year") == 2024)


register(Query("s04_pitch_table", _pitch_table, f"{KEY} game_date:d pitch_type:s run_value:f game_year:i", source="written"))


def _arsenal_file(t: Tables):
    table = t.pitcher_arsenals.select("pitcher", "p_throws", "num_pitch_types", "pitch_types", "fb_velo")
    base = _folder(t, "arsenals")
    FI.write_csv_versioned(table.limit(0), base, "first")
    return t.spark.read.option("header", True).csv(FI.write_csv_versioned(table, base, "second"))


register(Query("s05_arsenal_file", _arsenal_file, "pitcher:i p_throws:s num_pitch_types:i pitch_types:s fb_velo:f", source="pars"))


def _metadata(t: Tables):
    numeric, categorical = ML.column_types(t.features)
    folder = _folder(t, "metadata")
    FI.write_metadata(t.spark, folder, ML.regression_metrics(_split_no_model(t)), numeric + categorical, numeric, categorical)
    kinds = t.spark.read.json(f"{folder}/inference_config").select(F.size("numeric_cols").alias("n_numeric"), F.size("categorical_cols").alias("n_categorical"))
    return t.spark.read.json(f"{folder}/metrics").join(F.broadcast(kinds))


register(Query("s08_metadata", _metadata, "split:s n:i rmse:f mae:f r2:f n_numeric:i n_categorical:i", source="metadata", keep=("raw",)))


def _renamed(t: Tables):
    """A log whose columns have other names: the first candidate that exists is taken."""
    log = t.raw.select(F.col("pitcher").alias("player_id"), F.col("pitch_type").alias("pitch_name"), "batter")
    return AN.distinct_arsenal(log, AN.resolve_column(log, ["pitcher", "pitcher_id", "player_id", "batter"]),
                               AN.resolve_column(log, ["pitch_type", "pitch_name"]))


register(Query("s11_renamed_columns", _renamed, "pitcher:i pitch_type:s", source="arsenal12"))


def _loaded_preprocessing(t: Tables):
    """M7: the fitted preprocessing, saved and loaded."""
    df, numeric, categorical, _ = ML.split_rows(t.whole_features)
    tr = df.filter(F.col("split") == "train")
    folder = _folder(t, "preprocessing")
    ML.save_model(ML.fit_preprocessing(tr, numeric, categorical), folder)
    return ML.preprocessing_summary(ML.load_model(folder), tr)


register(Query("m07_loaded_preprocessing", _loaded_preprocessing, "feature:s kind:s median:f mean:f std:f levels:s", source="m02", keep=("raw",)))
