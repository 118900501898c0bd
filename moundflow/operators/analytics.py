"""Analytic queries over the pitch tables.

All are grouped aggregates, rollups or equi-joins against small derived
tables (bounded by the game's domain: 12 counts x pitch types x 14 zones x
2 hands x 2 stances), so they shuffle the aggregated rows, never the pitches.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundflow import constants as K
from moundflow.functions.location import fits_rule, loc_horizontal, loc_vertical, rule_based_location
from moundflow.functions.pitch import _c, is_contact, is_swing, outcome_class, safe_divide
from moundflow.operators.order_stats import exact_quantiles
from moundflow.session import ensure_checkpoint_dir


# A12 -----------------------------------------------------------------------
def distinct_arsenal(raw: DataFrame, pitcher: str = "pitcher", pitch_type: str = "pitch_type") -> DataFrame:
    """Distinct non-null (pitcher, pitch_type); S11 picks the columns."""
    return (raw.select(F.col(pitcher).cast("long").alias("pitcher"), F.col(pitch_type).cast("string").alias("pitch_type"))
            .dropna().distinct())


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """First of the candidate names present, else an error listing the
    columns (a plan-time decision)."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} in columns {df.columns}")


# A13 / J13 -----------------------------------------------------------------
def matchup_stats(pitches: DataFrame) -> DataFrame:
    """wOBA, whiff rate and mean run value per (batter, pitch type, hand)."""
    sw, ct = is_swing("description"), is_contact("description")
    g = (pitches.filter(F.col("batter").isNotNull() & F.col("pitch_type").isNotNull() & F.col("p_throws").isNotNull())
         .groupBy("batter", "pitch_type", "p_throws")
         .agg(F.avg("woba_value").alias("batter_pitchtype_woba"),
              F.sum(sw.cast("long")).alias("_sw"), F.sum((sw & ~ct).cast("long")).alias("_wh"),
              F.avg("run_value").alias("batter_pitchtype_run_value"),
              F.count(F.lit(1)).alias("n")))
    return g.withColumn("batter_pitchtype_whiff_rate", safe_divide("_wh", "_sw")).drop("_sw", "_wh")


def matchup_lookup(keys: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach matchup stats on (batter, pitch_type, p_throws); missing -> 0."""
    s = stats.select("batter", "pitch_type", "p_throws", "batter_pitchtype_woba",
                     "batter_pitchtype_whiff_rate", "batter_pitchtype_run_value")
    j = keys.join(s, ["batter", "pitch_type", "p_throws"], "left")
    return j.fillna(0.0, subset=["batter_pitchtype_woba", "batter_pitchtype_whiff_rate", "batter_pitchtype_run_value"])


# A14 -----------------------------------------------------------------------
def top_pitch_types(arsenal: DataFrame, n: int = 3, default=("FF", "SL", "CU")) -> DataFrame:
    """Pitch types thrown by the most pitchers (ties by name), top n; the
    default list when the arsenal table is empty.  A top-k report: the limit
    is the feature (TakeOrdered, no global sort); the n survivors are folded
    into one bounded array so the fallback needs no join."""
    counts = arsenal.groupBy("pitch_type").agg(F.count(F.lit(1)).alias("pitchers"))
    top = counts.orderBy(F.desc("pitchers"), F.asc("pitch_type")).limit(n)
    arr = top.agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("pitchers")).alias("k"), F.col("pitch_type"), F.col("pitchers")))).alias("a"))
    dflt = F.array(*[F.struct(F.lit(0).cast("long").alias("k"), F.lit(t).alias("pitch_type"),
                              F.lit(None).cast("long").alias("pitchers")) for t in default[:n]])
    picked = arr.select(F.posexplode(F.when(F.size("a") > 0, F.col("a")).otherwise(dflt)).alias("pos", "e"))
    return picked.select((F.col("pos") + 1).alias("rank"), F.col("e.pitch_type").alias("pitch_type"),
                         F.col("e.pitchers").alias("pitchers"))


# A15 / A16 -----------------------------------------------------------------
def dataset_summary(pitches: DataFrame) -> DataFrame:
    """Rows, distinct players, date range and the run-value distribution
    (count, mean, sample std, min, quartiles by linear interpolation, max)."""
    # read several times, so written once
    ensure_checkpoint_dir(pitches.sparkSession)
    pitches = pitches.select("run_value", "game_date", "pitcher", "batter").checkpoint(eager=True)
    rv = F.col("run_value")
    quartiles = exact_quantiles(pitches, ["run_value"], [0.25, 0.5, 0.75])["run_value"]
    whole = pitches.agg(
        F.count(F.lit(1)).alias("pitches"),
        F.min("game_date").alias("first_date"),
        F.max("game_date").alias("last_date"),
        F.count(rv).alias("rv_count"),
        F.avg(rv).alias("rv_mean"),
        F.stddev_samp(rv).alias("rv_std"),
        F.min(rv).alias("rv_min"),
        F.max(rv).alias("rv_max"),
        *[F.lit(q).cast("double").alias(f"rv_p{p}") for p, q in zip((25, 50, 75), quartiles)],
    )
    # distinct players are counted after a distributed distinct
    for c in ("pitcher", "batter"):
        whole = whole.join(F.broadcast(pitches.groupBy(c).count().agg(F.count(c).alias(f"{c}s"))))     # one row each
    return whole


def run_value_stats(pitches: DataFrame) -> DataFrame:
    return pitches.agg(
        F.avg("run_value").alias("rv_mean"),
        F.stddev_samp("run_value").alias("rv_std"),
        F.sum("runs_on_play").alias("runs_total"),
        F.sum((F.col("runs_on_play") > 0).cast("long")).alias("scoring_plays"),
    )


# A17 / A18 -----------------------------------------------------------------
def rv_by_location(features: DataFrame) -> DataFrame:
    """Mean run value by horizontal bucket, by vertical bucket, and by both
    (grouping sets; ``level`` tells which)."""
    g = features.cube("loc_horizontal", "loc_vertical").agg(
        F.grouping_id().alias("level"), F.avg("run_value").alias("mean_rv"), F.count(F.lit(1)).alias("pitches"))
    return g.filter(F.col("level") != 3)


def best_worst_location(features: DataFrame) -> DataFrame:
    """Per pitch type, the (h, v) cell with the lowest / highest mean run
    value (ties by cell name)."""
    cells = (features.filter(F.col("loc_horizontal").isNotNull() & F.col("loc_vertical").isNotNull())
             .groupBy("pitch_type", "loc_horizontal", "loc_vertical")
             .agg(F.avg("run_value").alias("mean_rv")))
    cell = F.concat_ws("-", "loc_horizontal", "loc_vertical")
    return cells.groupBy("pitch_type").agg(
        F.min_by(cell, F.struct(F.col("mean_rv"), cell)).alias("best_location"),
        F.min("mean_rv").alias("best_rv"),
        F.min_by(cell, F.struct(-F.col("mean_rv"), cell)).alias("worst_location"),
        F.max("mean_rv").alias("worst_rv"))


# A19 / J8 ------------------------------------------------------------------
def count_text(balls="balls", strikes="strikes") -> Column:
    return F.concat_ws("-", _c(balls).cast("long").cast("string"), _c(strikes).cast("long").cast("string"))


BASELINE_KEYS = ["count", "pitch_type", "zone", "p_throws", "stand"]


def baseline_table(pitches: DataFrame) -> DataFrame:
    """Mean run value at every rollup level of (count, pitch type, zone,
    pitcher hand, batter stance); rolled-up keys read '*'."""
    df = pitches.select(count_text().alias("count"), "pitch_type",
                        F.col("zone").cast("long").cast("string").alias("zone"), "p_throws", "stand", "run_value")
    g = df.rollup(*BASELINE_KEYS).agg(F.grouping_id().alias("level"), F.avg("run_value").alias("rv"),
                                      F.count(F.lit(1)).alias("n"),
                                      *[F.grouping(k).alias(f"_g_{k}") for k in BASELINE_KEYS])
    return g.select(*[F.when(F.col(f"_g_{k}") == 1, F.lit("*")).otherwise(F.col(k)).alias(k) for k in BASELINE_KEYS],
                    "level", "rv", "n")


# levels used by the lookup: full, stance+hand rolled, zone rolled, pitch rolled
BACKOFF = [("full", 0), ("zone", 3), ("pitch", 7), ("count", 15)]


def baseline_closure(keys: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per distinct key the value and the level its backoff ends at.  The keys are
    bounded by the game (counts, pitch types, zones, hands), whatever the rows."""
    out = keys
    picked = []
    for name, level in BACKOFF:
        n_keys = {0: 5, 3: 3, 7: 2, 15: 1}[level]
        b = baseline.filter(F.col("level") == level).select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(BASELINE_KEYS[:n_keys])], F.col("rv").alias(f"_bl_{name}"))
        cond = None
        for i in range(n_keys):
            c = F.col(f"_k{i}") == F.col(f"_b{i}")
            cond = c if cond is None else cond & c
        out = out.join(b, cond, "left").drop(*[f"_b{i}" for i in range(n_keys)])
        picked.append(f"_bl_{name}")
    level_name = F.coalesce(*[F.when(F.col(p).isNotNull(), F.lit(n)) for p, (n, _) in zip(picked, BACKOFF)])
    return out.select(*[f"_k{i}" for i in range(5)], F.coalesce(*[F.col(p) for p in picked]).alias("baseline_rv"), level_name.alias("baseline_level"))


def baseline_lookup(df: DataFrame, baseline: DataFrame, count="count", pitch_type="pitch_type",
                    zone="zone", p_throws="p_throws", stand="stand") -> DataFrame:
    """First match of (count, pitch, zone, hand, stance) ->
    (count, pitch, zone, *) -> (count, pitch, *) -> (count, *).  The four levels
    are resolved once per distinct key; the rows meet the result in one join."""
    key = [_c(count), _c(pitch_type), _c(zone).cast("long").cast("string"), _c(p_throws), _c(stand)]
    keys = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
    closure = baseline_closure(keys, baseline)
    same = None
    for i, k in enumerate(key):
        c = k.eqNullSafe(F.col(f"_k{i}"))
        same = c if same is None else same & c
    return df.join(closure, same, "left").drop(*[f"_k{i}" for i in range(5)])


# A20 / A21 / R12 -----------------------------------------------------------
def outcome10(description="description", events="events") -> Column:
    """Ten EPRV outcomes from the seven outcome classes, hits split by the
    exact event; hit-by-pitch -> HBP; anything else null (excluded)."""
    oc = outcome_class(description, events)
    ev = F.lower(_c(events))
    d = F.lower(_c(description))
    inplay = F.when(ev == "single", "1B").when(ev == "double", "2B").when(ev == "triple", "3B") \
        .when(ev == "home_run", "HR").otherwise("inplay_out")
    return (F.when(oc.isin("ball", "called_strike", "swinging_strike", "foul"), oc)
            .when(oc.isin("in_play_hit", "in_play_out"), inplay)
            .when(d == "hit_by_pitch", F.lit("HBP")))


def outcome_rv_table(pitches: DataFrame) -> DataFrame:
    """Mean run value per (outcome, count)."""
    df = pitches.select(outcome10().alias("outcome"), count_text().alias("count"), "run_value")
    return (df.filter(F.col("outcome").isNotNull())
            .groupBy("outcome", "count").agg(F.avg("run_value").alias("rv"), F.count(F.lit(1)).alias("n")))


def outcome_distribution(pitches: DataFrame) -> DataFrame:
    """P(outcome | count, pitch type): empirical shares, summing to 1 per
    context (a window over the small aggregated table)."""
    df = pitches.select(outcome10().alias("outcome"), count_text().alias("count"), "pitch_type")
    g = df.filter(F.col("outcome").isNotNull()).groupBy("count", "pitch_type", "outcome").agg(
        F.count(F.lit(1)).alias("n"))
    return g.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("count", "pitch_type")))


def eprv_by_context(dist: DataFrame, rv_table: DataFrame) -> DataFrame:
    """raw EPRV per (count, pitch type) = sum over outcomes of p * rv."""
    j = dist.join(rv_table.select("outcome", "count", F.col("rv").alias("_rv")), ["outcome", "count"], "left")
    return j.groupBy("count", "pitch_type").agg(
        F.sum(F.col("p") * F.coalesce(F.col("_rv"), F.lit(0.0))).alias("raw_eprv"))


def count_distribution(dist: DataFrame) -> DataFrame:
    """The backoff of ``outcome_distribution``: P(outcome | count) over all
    pitch types, from the same additive counts."""
    g = dist.groupBy("count", "outcome").agg(F.sum("n").alias("n"))
    return g.select("count", F.lit("*").alias("pitch_type"), "outcome", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("count"))).alias("p"))


def eprv_candidates(candidates: DataFrame, eprv: DataFrame, baseline: DataFrame, by_count: DataFrame | None = None) -> DataFrame:
    """R12 per candidate: raw EPRV, its baseline by backoff, and
    RVAA = raw - baseline.  ``candidates`` has request_id, count, pitch_type,
    zone, p_throws, stand.  A (count, pitch type) that was never seen takes the
    EPRV of its count (``by_count``: ``eprv_by_context`` of
    ``count_distribution``), so it stays in the choice."""
    c = candidates.join(eprv, ["count", "pitch_type"], "left")
    if by_count is not None:
        c = c.join(by_count.select("count", F.col("raw_eprv").alias("_of_count")), "count", "left")
        c = c.withColumn("raw_eprv", F.coalesce("raw_eprv", "_of_count")).drop("_of_count")
    c = baseline_lookup(c, baseline)
    return c.withColumn("rvaa", F.col("raw_eprv") - F.col("baseline_rv"))


def choose_eprv(cands: DataFrame, *by: str) -> DataFrame:
    """Pick per request (or per ``by``) the minimum (rvaa, raw_eprv), ties by pitch
    then zone."""
    own = cands.withColumns({"best_pitch": F.col("pitch_type"), "best_zone": F.col("zone"), "candidates": F.lit(1).cast("long")})
    return best_choice(own, *(by or ("request_id",)))


def best_choice(choices: DataFrame, *by: str) -> DataFrame:
    """The choice of choices per ``by``: the order of ``choose_eprv`` is total, so the
    best of the parts' best is the best of all; candidates add up."""
    key = F.struct("rvaa", "raw_eprv", "best_pitch", "best_zone")
    ok = F.col("rvaa").isNotNull()
    fields = ["best_pitch", "best_zone", "raw_eprv", "baseline_rv", "rvaa"]
    best = choices.groupBy(*by).agg(F.min_by(F.when(ok, F.struct(*fields)), F.when(ok, key)).alias("_b"), F.sum("candidates").alias("candidates"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in fields], "candidates")


# A26 -----------------------------------------------------------------------
def calibration(df: DataFrame, predicted: str, observed: str, bins: int = 10) -> DataFrame:
    """Predicted vs observed rate by probability decile."""
    b = F.least(F.floor(F.col(predicted) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(predicted).alias("mean_predicted"),
                                          F.avg(F.col(observed).cast("double")).alias("observed_rate"),
                                          F.count(F.lit(1)).alias("n"))


# A25 -----------------------------------------------------------------------
#: Weighted copies of the rows that give a policy's interval.
REPLICATES = 12
#: P(w <= k) of a Poisson weight of mean one, in millionths.
POISSON = [367_879, 735_759, 919_699, 981_012, 996_340, 999_406, 999_917, 999_990]


def poisson_weight(replicate: int) -> Column:
    """A Poisson weight of mean one, drawn from the pitch's key: whole-number
    arithmetic, so any engine draws the same."""
    key = F.col("game_pk") * 7919 + F.col("at_bat_number") * 104729 + F.col("pitch_number") * 1299709 + F.lit(replicate * 15485863)
    u = F.pmod(F.pmod(key * 48271 + 11, F.lit(2147483647)) * 69621 + 7, F.lit(1000003)) * F.lit(1000000) / F.lit(1000003)
    return sum((u >= F.lit(p)).cast("int") for p in POISSON)


def game_fold(folds: int = 2) -> Column:
    return F.coalesce(F.pmod(F.col("game_pk"), F.lit(folds)), F.lit(0))


def cross_fitted_locations(features: DataFrame, folds: int = 2) -> DataFrame:
    """Per (fold, pitch type) the best and the worst cell by the mean run value
    in all other folds: sums by fold are additive, so one pass serves all folds."""
    cell = F.concat_ws("-", "loc_horizontal", "loc_vertical")
    sums = (features.where(F.col("loc_horizontal").isNotNull() & F.col("loc_vertical").isNotNull() & F.col("run_value").isNotNull())
            .groupBy(game_fold(folds).alias("fold"), "pitch_type", cell.alias("cell")).agg(F.sum("run_value").alias("s"), F.count(F.lit(1)).alias("n")))
    others = (sums.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))).alias("held"), "pitch_type", "cell", "s", "n")
              .groupBy(F.col("held").alias("fold"), "pitch_type", "cell").agg(F.round(F.sum("s") / F.sum("n"), 12).alias("mean_rv")))
    return others.groupBy("fold", "pitch_type").agg(F.min_by("cell", F.struct("mean_rv", "cell")).alias("best_location"),
                                                    F.min_by("cell", F.struct(-F.col("mean_rv"), "cell")).alias("worst_location"))


def decision_quality(features: DataFrame, folds: int = 2, modelled: DataFrame | None = None, replicates: int = REPLICATES) -> DataFrame:
    """Mean run value, its bootstrap deviation and strike share of pitches
    by location policy: every pitch ('actual'), those thrown in their type's best
    cell ('recommended') or worst ('worst'), both chosen on the other folds of
    games and judged on the held one; where the rule table wants them
    ('rule_based'), in a cell drawn for the pitch ('random'), inside the zone
    ('in_zone'), and in the cell a model prefers for the pitch ('model', with
    ``modelled``: the pitch key and ``cell``).  All sums are additive."""
    cell = F.concat_ws("-", "loc_horizontal", "loc_vertical")
    j = features.withColumn("fold", game_fold(folds)).join(cross_fitted_locations(features, folds), ["fold", "pitch_type"], "left")
    keys = ["game_pk", "at_bat_number", "pitch_number"]
    j = j.withColumn("_model", F.lit(None).cast("string")) if modelled is None else j.join(modelled.select(*keys, F.col("cell").alias("_model")), keys, "left")
    drawn = F.pmod(F.col("game_pk") * 31 + F.col("at_bat_number") * 17 + F.col("pitch_number") * 7, F.lit(len(K.H_LABELS) * len(K.V_LABELS)))
    cells = F.array(*[F.lit(f"{h}-{v}") for h in K.H_LABELS for v in K.V_LABELS])
    rule = fits_rule(rule_based_location("pitch_type", "stand"), "loc_horizontal", "loc_vertical")
    tags = F.filter(F.array(
        F.lit("actual"),
        F.when(cell == F.col("best_location"), F.lit("recommended")),
        F.when(cell == F.col("worst_location"), F.lit("worst")),
        F.when(rule, F.lit("rule_based")),
        F.when(cell == F.get(cells, drawn.cast("int")), F.lit("random")),
        F.when(cell == F.col("_model"), F.lit("model")),
        F.when(F.col("in_zone") == 1, F.lit("in_zone"))), lambda x: x.isNotNull())
    weights = {f"_w{b}": poisson_weight(b) for b in range(replicates)}
    t = j.select(F.explode(tags).alias("policy"), "run_value", "in_zone", *[w.alias(n) for n, w in weights.items()])
    rv = F.col("run_value")
    g = t.groupBy("policy").agg(
        F.avg(rv).alias("mean_rv"), F.avg(F.col("in_zone").cast("double")).alias("strike_share"), F.count(F.lit(1)).alias("n"),
        *[F.try_divide(F.sum(rv * F.col(w)), F.sum(F.when(rv.isNotNull(), F.col(w)))).alias(w) for w in weights])
    means = F.array(*[F.col(w) for w in weights])
    total = F.aggregate(means, F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(means, F.lit(0.0), lambda a, x: a + (x - total / replicates) * (x - total / replicates))
    return g.select("policy", "mean_rv", F.sqrt(spread / (replicates - 1)).alias("se_rv"), "strike_share", "n")


def modelled_cells(best: DataFrame) -> DataFrame:
    """The pitch key and the bucket cell of the place a model prefers for it;
    ``best`` has the key and ``plate_x``, ``plate_z``."""
    keys = ["game_pk", "at_bat_number", "pitch_number"]
    return best.select(*keys, F.concat_ws("-", loc_horizontal("plate_x"), loc_vertical("plate_z")).alias("cell"))


# S10 -----------------------------------------------------------------------
def season_union(*seasons: DataFrame) -> DataFrame:
    out = seasons[0]
    for s in seasons[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def union_stats(df: DataFrame, pitcher_id: int | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("pitches"), F.countDistinct("pitcher").alias("pitchers"),
            F.countDistinct("batter").alias("batters")]
    if pitcher_id is not None:
        aggs.append(F.sum((F.col("pitcher") == pitcher_id).cast("long")).alias("pitcher_pitches"))
    return df.agg(*aggs)


def season_summary(df: DataFrame, season: str = "season") -> DataFrame:
    """A season's rows, and its players as bitmaps: (season, role, bucket,
    bitmap, pitches).  A bitmap has 32,768 ids of a role; summaries are stored and
    merged, so a new season costs its own rows only.  The count of rows stands
    in the row of the role ``pitches``."""
    rows = df.groupBy(F.col(season).alias("season")).agg(F.count(F.lit(1)).alias("pitches")).select(
        "season", F.lit("pitches").alias("role"), F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bitmap"), "pitches")
    for role in ("pitcher", "batter"):
        ids = df.where(F.col(role).isNotNull()).select(F.col(season).alias("season"), F.col(role).cast("long").alias("id"))
        bits = ids.groupBy("season", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))
        rows = rows.unionByName(bits.select("season", F.lit(role).alias("role"), "bucket", "bitmap", F.lit(0).cast("long").alias("pitches")))
    return rows


def merge_seasons(summaries: DataFrame, by: Column | None = None) -> DataFrame:
    """Pitches and distinct pitchers and batters of stored summaries, exactly:
    by a column over ``season``, or of all together."""
    s = summaries.withColumn("seasons", F.lit("all") if by is None else by)
    merged = s.groupBy("seasons", "role", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("pitches").alias("pitches"))
    ids = F.coalesce(F.bitmap_count("bitmap"), F.lit(0))
    return merged.groupBy("seasons").agg(F.sum("pitches").alias("pitches"), F.sum(F.when(F.col("role") == "pitcher", ids)).alias("pitchers"),
                                       F.sum(F.when(F.col("role") == "batter", ids)).alias("batters"))


# E27 -----------------------------------------------------------------------
def text_search(df: DataFrame, query: str, cols: list[str] | None = None) -> DataFrame:
    """Rows where the text of any one column (all columns by default, numbers
    and dates included) contains the query, case-insensitive."""
    texts = [F.lower(F.col("`" + c.replace("`", "``") + "`").cast("string")) for c in cols or df.columns]
    return df.filter(F.exists(F.array(*texts), lambda x: x.contains(query.lower())))


# A24 -----------------------------------------------------------------------
def unique_players(raw: DataFrame, role: str, names: DataFrame | None = None) -> DataFrame:
    """Distinct player ids of one role, with names when a name map is given."""
    ids = raw.select(F.col(role).cast("long").alias(role)).dropna().distinct()
    if names is None:
        return ids
    n = names.select(F.col("id").cast("long").alias(role), F.col("name"))
    return ids.join(n, role, "left")
