"""Ranked next-pitch recommendations for a whole
table of requests in one plan.

requests ⋈ arsenal (explode, bounded by the pitcher's pitch types)
         ⋈ batter profile ⋈ pitcher-pitch profile   (per-player tables)
  -> one feature projection shared with training (F1-F7 rules)
  -> score (model ``transform`` or the no-model rule)
  -> softmax / rank windows per request (a handful of rows each)
  -> optional 25-cell location grid per candidate (explode of a literal
     array, no join) scored in the same ``transform`` and reduced with
     ``min_by`` per candidate.
"""
from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundflow import constants as K
from moundflow.functions.location import coords_to_zone, loc_horizontal, loc_vertical, location_label
from moundflow.functions.pitch import fill, pitch_category
from moundflow.operators.features import add_interaction_features, add_situational_features, batter_zones
from moundflow.operators.runvalue import run_expectancy
from moundflow.session import task_slots

CATS = K.CATEGORIES


# R1 ------------------------------------------------------------------------
def resolve_arsenal(requests: DataFrame, arsenals: DataFrame, pitcher_profiles: DataFrame) -> DataFrame:
    """One row per (request, pitch) with its position in the arsenal:
    summary list -> distinct profile types -> [FF, SL, CH]."""
    a1 = arsenals.select("pitcher", F.col("pitch_type_list").alias("_a1"))
    a2 = pitcher_profiles.groupBy("pitcher").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("p_throws", "pitch_type"))),
                    lambda x: x["pitch_type"]).alias("_a2"))
    a2 = a2.select("pitcher", F.array_distinct("_a2").alias("_a2"))
    default = F.array(*[F.lit(t) for t in K.DEFAULT_ARSENAL])
    j = requests.join(a1, "pitcher", "left").join(a2, "pitcher", "left")
    arsenal = (F.when(F.size("_a1") > 0, F.col("_a1"))
               .when(F.size("_a2") > 0, F.col("_a2")).otherwise(default))
    j = j.withColumn("_arsenal", arsenal).drop("_a1", "_a2")
    return j.select("*", F.posexplode("_arsenal").alias("arsenal_pos", "pitch_type")).drop("_arsenal")


# R2 / R3 -------------------------------------------------------------------
def attach_batter(cands: DataFrame, wide: DataFrame) -> DataFrame:
    """R2: the batter's wide profile, else league averages.  A category the
    profile has no column for (UNKNOWN) takes the fixed defaults."""
    stats = ["whiff_rate", "chase_rate", "zone_contact_rate", "gb_rate", "xwoba"]
    w = wide.select("batter", *[F.col(f"{s}_vs_{c}").alias(f"_w_{s}_{c}") for s in stats for c in CATS])
    df = cands.join(w, "batter", "left").withColumn("pitch_category", pitch_category("pitch_type"))
    cat = F.col("pitch_category")
    cols = {}
    for s in stats:
        pick = None
        for c in CATS:
            v = F.coalesce(F.col(f"_w_{s}_{c}"), F.lit(K.LEAGUE_AVERAGES[c][s]))
            pick = F.when(cat == c, v) if pick is None else pick.when(cat == c, v)
        cols[f"batter_{s}_vs_this_cat"] = pick.otherwise(F.lit(K.BATTER_THIS_CAT_DEFAULTS[s]))
    for s in ["whiff_rate", "chase_rate", "xwoba"]:
        for c in CATS:
            cols[f"{s}_vs_{c}"] = F.coalesce(F.col(f"_w_{s}_{c}"), F.lit(K.LEAGUE_AVERAGES[c][s]))
    df = df.withColumns(cols)
    return df.drop(*[f"_w_{s}_{c}" for s in stats for c in CATS])


PROFILE_FIELDS = ["avg_velo", "avg_spin", "avg_pfx_x", "avg_pfx_z", "whiff_rate", "strike_rate",
                  "usage_rate", "velo_diff_from_fb"]


def attach_pitcher(cands: DataFrame, profiles: DataFrame) -> DataFrame:
    """The (pitcher, type) profile row — first by hand when a pitcher
    throws with both — else category defaults (unknown -> FB)."""
    p = profiles.groupBy("pitcher", "pitch_type").agg(
        F.min_by(F.struct("p_throws", *PROFILE_FIELDS), F.col("p_throws")).alias("_p"))
    df = cands.join(p, ["pitcher", "pitch_type"], "left")
    cat = F.col("pitch_category")
    found = F.col("_p").isNotNull()

    def by_cat(field):
        expr = None
        for c in CATS:
            v = F.lit(float(K.PITCHER_DEFAULTS_BY_CATEGORY[c][field]))
            expr = F.when(cat == c, v) if expr is None else expr.when(cat == c, v)
        return expr.otherwise(F.lit(float(K.PITCHER_DEFAULTS_BY_CATEGORY["FB"][field])))

    cols = {"p_throws": F.when(found, F.col("_p.p_throws")).otherwise(F.lit(K.PITCHER_DEFAULTS_COMMON["p_throws"]))}
    for f in PROFILE_FIELDS:
        dflt = by_cat(f) if f in ("avg_velo", "avg_spin", "velo_diff_from_fb") else F.lit(float(K.PITCHER_DEFAULTS_COMMON[f]))
        cols[f"pitcher_{f}"] = F.when(found, F.col(f"_p.{f}")).otherwise(dflt)
    return df.withColumns(cols).drop("_p")


# R4 ------------------------------------------------------------------------
def candidate_features(df: DataFrame) -> DataFrame:
    """The model's feature names for each candidate, from the request and the
    resolved profiles, by the projections that training uses (F1-F7): bases are
    0 or 1 as after cleaning, outs stand under the log's name."""
    last = F.col("last_pitch_type")
    known = last.isNotNull() & (last != "")
    df = df.withColumns({c: F.coalesce((F.col(c) != 0).cast("int"), F.lit(0)) for c in ("on_1b", "on_2b", "on_3b")} | {"outs_when_up": F.col("outs")})
    df = add_interaction_features(add_situational_features(df)).drop("outs_when_up")
    return df.withColumns({
        "last_pitch_category": F.when(known, pitch_category(last)),
        "same_as_last": F.when(known, F.coalesce((F.col("pitch_type") == last).cast("int"), F.lit(0))).otherwise(F.lit(0)),
        "consecutive_same_pitch": F.lit(0),
        "speed_delta": F.lit(0.0),
    })


# R7 / M8 -------------------------------------------------------------------
def no_model_rv(df: DataFrame) -> Column:
    """rv = 0.1 - 0.4 * batter whiff rate vs this category."""
    return F.lit(K.NO_MODEL_RV_INTERCEPT) - F.col("batter_whiff_rate_vs_this_cat") * K.NO_MODEL_RV_SLOPE


def score(df: DataFrame, model=None, out: str = "predicted_rv", keep_vector: bool = False) -> DataFrame:
    """Model prediction (missing feature columns filled with 0, as the
    published scorer does) or the no-model rule."""
    if model is None:
        return df.withColumn(out, no_model_rv(df))
    from moundflow.operators.model import predict
    return predict(model, df, out, keep_vector)


# E24 -----------------------------------------------------------------------
def _pct(x: Column) -> Column:
    # Python's '{:.0%}': round-half-even of x*100
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


THRESHOLDS = {c: {"whiff_hi": v["whiff_rate"] + K.REASON_WHIFF_MARGIN, "whiff_lo": v["whiff_rate"] - K.REASON_WHIFF_MARGIN,
                  "chase_hi": v["chase_rate"] + K.REASON_CHASE_MARGIN} for c, v in K.LEAGUE_AVERAGES.items()}


def reasoning(category: Column, whiff: Column, chase: Column, xwoba: Column, balls: Column, strikes: Column) -> Column:
    """Up to five clauses joined by '; ', else 'Standard option'.  An
    unknown category uses the FB league row."""
    def thr(key):
        expr = None
        for c in CATS:
            expr = F.when(category == c, F.lit(THRESHOLDS[c][key])) if expr is None else \
                expr.when(category == c, F.lit(THRESHOLDS[c][key]))
        return expr.otherwise(F.lit(THRESHOLDS["FB"][key]))

    parts = [
        F.when(whiff > thr("whiff_hi"), fill(K.REASON_HIGH_WHIFF, category, _pct(whiff)))
         .when(whiff < thr("whiff_lo"), fill(K.REASON_GOOD_CONTACT, category)),
        F.when(chase > thr("chase_hi"), fill(K.REASON_CHASES, category, _pct(chase))),
        F.when(xwoba < K.REASON_XWOBA_LOW, fill(K.REASON_WEAK_CONTACT, F.format_string("%.3f", xwoba)))
         .when(xwoba > K.REASON_XWOBA_HIGH, fill(K.REASON_DANGEROUS, F.format_string("%.3f", xwoba))),
        F.when((strikes == 2) & category.isin("BR", "OS"), F.lit(K.REASON_PUT_AWAY)),
        F.when((balls == 3) & (category == "FB"), F.lit(K.REASON_NEED_STRIKE)),
    ]
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", F.lit(K.REASON_DEFAULT)).otherwise(text)


# R6 ------------------------------------------------------------------------
def _grid_cells() -> Column:
    cells, i = [], 0
    for x in K.GRID_X:
        for z in K.GRID_Z:
            cells.append(F.struct(F.lit(i).alias("cell_no"), F.lit(float(x)).alias("plate_x"),
                                  F.lit(float(z)).alias("plate_z")))
            i += 1
    return F.array(*cells)


#: A batter's record at a zone, and what stands in where the batter has none.
ZONE_STATS = {"swing_rate": 0.5, "whiff_rate": 0.25, "contact_rate": 0.75, "xwoba": 0.32}
CARRY = ["pitch_type", "pitch_category", "predicted_rv", "probability", "current_re", "balls", "strikes",
         "batter_whiff_rate_vs_this_cat", "batter_chase_rate_vs_this_cat", "batter_xwoba_vs_this_cat"]


def optimize_locations(cands: DataFrame, zone_long: DataFrame, model=None, carry=CARRY, scorer: Column | None = None) -> DataFrame:
    """Score 25 grid cells per candidate and keep the lowest predicted
    run value (first cell wins ties).

    Each candidate expands to a fixed 25 rows through ``explode`` of a
    literal array (a bounded fan-out, not a join); the cells are scored by
    one ``transform``; the reduction per candidate keeps only the winning
    cell number and the candidate's output columns (carried in a narrow
    struct, so no join back and no recomputation of the candidate plan).
    Candidates arrive hash-partitioned by request, so the reduction and the
    later rank window add no shuffle.  ``scorer``, a column over the cell's and
    the candidate's columns, takes the model's place; its cells are columns of the
    candidate's row (``_scored_cells``).
    """
    if scorer is not None:
        return _scored_cells(cands, zone_long, carry, scorer)
    keep = F.struct(*[F.col(c) for c in carry]).alias("_cand")
    g = cands.select("request_id", "arsenal_pos", keep, *[F.col(c) for c in cands.columns
                                                         if c not in ("request_id", "arsenal_pos")],
                     F.explode(_grid_cells()).alias("_cell"))
    g = g.withColumns({
        "plate_x": F.col("_cell.plate_x"), "plate_z": F.col("_cell.plate_z"), "cell_no": F.col("_cell.cell_no"),
    }).drop("_cell")
    g = g.withColumn("zone", coords_to_zone("plate_x", "plate_z").cast("long"))
    g = g.withColumns({
        "in_zone": ((F.col("zone") >= 1) & (F.col("zone") <= 9)).cast("int"),
        # the buckets the model was trained on (right-closed); the left-closed
        # scoring buckets stay functions of their own
        "loc_horizontal": loc_horizontal("plate_x"),
        "loc_vertical": loc_vertical("plate_z"),
    })
    z = zone_long.select(F.col("batter").alias("_zb"), F.col("zone").cast("long").alias("_zz"),
                         F.lit(True).alias("_zhit"),
                         *[F.col(s).alias(f"_z_{s}") for s in ["swing_rate", "whiff_rate", "contact_rate", "xwoba"]])
    g = g.join(z, (F.col("batter") == F.col("_zb")) & (F.col("zone") == F.col("_zz")), "left")
    g = g.withColumns({f"batter_{s}_at_zone": F.when(F.col("_zhit"), F.col(f"_z_{s}")).otherwise(F.lit(d))
                       for s, d in ZONE_STATS.items()}).drop("_zb", "_zz", "_zhit", *[f"_z_{s}" for s in ZONE_STATS])
    # score only what the model reads: narrow rows through the transformer chain
    if model is not None:
        from moundflow.operators.model import model_inputs
        needed = model_inputs(model)
    else:
        needed = ["batter_whiff_rate_vs_this_cat"]
    g = g.select("request_id", "arsenal_pos", "_cand", "cell_no", *[c for c in needed if c in g.columns])
    g = score(g, model, out="_cell_rv")
    return _best_cells(g.select("request_id", "arsenal_pos", "_cand", "cell_no", "_cell_rv"))


def _scored_cells(cands: DataFrame, zone_long: DataFrame, carry: list[str], scorer: Column) -> DataFrame:
    """The cells scored by a column: the batter's zones come as one map a
    candidate, the scorer is applied once per cell inside the candidate's row, and
    the least value (the first of equal ones) is chosen there.  Candidates move
    once, by batter, and no row per cell is made."""
    names = ["cell_no", "plate_x", "plate_z", "zone", "in_zone", "loc_horizontal", "loc_vertical", *[f"batter_{s}_at_zone" for s in ZONE_STATS]]
    own = [c for c in cands.columns if c not in names]
    g = cands.select(*own, F.struct(*carry).alias("_cand")).join(batter_zones(zone_long).withColumnRenamed("batter", "_zb"), F.col("batter") == F.col("_zb"), "left")
    number = 0
    for x in K.GRID_X:
        for z in K.GRID_Z:
            place = g.withColumns({"cell_no": F.lit(number), "plate_x": F.lit(float(x)), "plate_z": F.lit(float(z))})
            place = place.withColumn("zone", coords_to_zone("plate_x", "plate_z").cast("long"))
            at = F.try_element_at("_zones", F.col("zone"))
            place = place.withColumns({
                "in_zone": ((F.col("zone") >= 1) & (F.col("zone") <= 9)).cast("int"),
                "loc_horizontal": loc_horizontal("plate_x"), "loc_vertical": loc_vertical("plate_z"),
                **{f"batter_{s}_at_zone": F.when(at.isNotNull(), at[s]).otherwise(F.lit(d)) for s, d in ZONE_STATS.items()}})
            g = place.withColumn(f"_rv_{number}", scorer).drop(*names)
            number += 1
    return _located(g.select("request_id", "arsenal_pos", "_cand", _least(number).alias("_best")))


def _least(cells: int) -> Column:
    """The least of the cells' values ``_rv_<cell>``, the first of equal ones."""
    return F.array_min(F.array(*[F.struct(F.col(f"_rv_{i}").alias("_cell_rv"), F.lit(i).alias("cell_no")) for i in range(cells)]))


def _best_cells(g: DataFrame) -> DataFrame:
    """Per candidate the cell of the lowest value, the first of equal ones."""
    best = g.groupBy("request_id", "arsenal_pos").agg(
        F.first("_cand").alias("_cand"),
        F.min_by(F.struct(F.col("cell_no"), F.col("_cell_rv")),
                 F.struct(F.col("_cell_rv"), F.col("cell_no"))).alias("_best"))
    return _located(best)


def _located(best: DataFrame) -> DataFrame:
    """The columns of a candidate and the place of its best cell."""
    cell = F.col("_best.cell_no") + 1
    xs = F.array(*[F.lit(float(x)) for x in K.GRID_X for _ in K.GRID_Z])
    zs = F.array(*[F.lit(float(z)) for _ in K.GRID_X for z in K.GRID_Z])
    px, pz = F.element_at(xs, cell), F.element_at(zs, cell)
    zone = coords_to_zone(px, pz).cast("long")
    return best.select("request_id", "arsenal_pos", "_cand.*", F.struct(
        px.alias("plate_x"), pz.alias("plate_z"), zone.alias("zone"),
        ((zone >= 1) & (zone <= 9)).cast("int").alias("in_zone"),
        F.col("_best._cell_rv").alias("expected_rv")).alias("location"))


def optimize_vectors(cands: DataFrame, zone_long: DataFrame, model, carry=CARRY) -> DataFrame:
    """R6 with a model: as ``optimize_locations``, over candidates that keep
    their preprocessed ``features``.  A candidate is preprocessed once; its 25
    vectors differ in the place's slots only, and only the trees see them.  The
    batter's zones come as one map a candidate (``_zones``, joined here where the
    candidates have none), not one join row a cell.  Candidates that are partitioned
    by request and have their zones are not moved again."""
    from moundflow.operators.model import LocationSlots
    fixed, looked_up = ["plate_x", "plate_z", "zone", "in_zone"], [f"batter_{s}_at_zone" for s in ZONE_STATS]
    cells = []
    for x in K.GRID_X:
        for z in K.GRID_Z:
            cells.append((float(x), float(z)))
    spark = cands.sparkSession
    places = spark.createDataFrame([(i, x, z) for i, (x, z) in enumerate(cells)], "i int, plate_x double, plate_z double").select(
        "i", "plate_x", "plate_z", coords_to_zone("plate_x", "plate_z").cast("double").alias("zone"),
        loc_horizontal("plate_x").alias("loc_horizontal"), loc_vertical("plate_z").alias("loc_vertical")).orderBy("i").collect()      # 25 rows
    slots = LocationSlots(model, spark, [{"plate_x": r.plate_x, "plate_z": r.plate_z, "zone": r.zone, "in_zone": float(1 <= r.zone <= 9),
                                          "loc_horizontal": r.loc_horizontal or "missing", "loc_vertical": r.loc_vertical or "missing"} for r in places],
                          fixed, looked_up, ["loc_horizontal", "loc_vertical"])
    grid = F.array(*[F.struct(F.lit(i).alias("cell_no"), F.lit(int(r.zone)).cast("long").alias("zone"),
                              F.array(*map(F.lit, slots.numbers[i])).alias("numbers"), F.array(*map(F.lit, slots.levels[i])).alias("levels"))
                     for i, r in enumerate(places)])
    if "_zones" not in cands.columns:
        cands = cands.join(batter_zones(zone_long), "batter", "left")
    # what no cell changes is cut out of the vector once a candidate
    g = cands.select("request_id", "arsenal_pos", F.struct(*carry).alias("_cand"), *slots.kept(vector_to_array("features")), "_zones")
    g = g.select("*", F.explode(grid).alias("_cell"))
    at = F.try_element_at("_zones", F.col("_cell.zone"))
    stats = [F.when(at.isNotNull(), at[s]).otherwise(F.lit(d)) for s, d in ZONE_STATS.items()]
    g = g.select("request_id", "arsenal_pos", "_cand", "_cell.cell_no",
                 slots.vector(F.col("_cell.numbers"), F.col("_cell.levels"), stats).alias("features"))
    g = model.stages[-1].transform(g)
    # a number a cell: a hash aggregate, where a struct's minimum would sort all cells with their candidates
    g = g.groupBy("request_id", "arsenal_pos", "_cand").agg(*[F.max(F.when(F.col("cell_no") == i, F.col("prediction"))).alias(f"_rv_{i}") for i in range(len(places))])
    return _located(g.select("request_id", "arsenal_pos", "_cand", _least(len(places)).alias("_best")))


# R5 ------------------------------------------------------------------------
def recommend(requests: DataFrame, arsenals: DataFrame, pitcher_profiles: DataFrame, batter_wide: DataFrame,
              zone_long: DataFrame | None = None, model=None, top_n: int | None = None,
              optimize_location: bool = True) -> DataFrame:
    """One row per (request, recommended pitch), ranked by probability."""
    c = resolve_arsenal(requests, arsenals, pitcher_profiles)
    c = attach_batter(c, batter_wide)
    grid = model is not None and optimize_location and zone_long is not None
    if grid:            # beside the batter's profile, so that vectors are not moved for the zones
        c = c.join(batter_zones(zone_long), "batter", "left")
    c = attach_pitcher(c, pitcher_profiles)
    c = candidate_features(c)
    # spread the candidates over the cluster by request: scoring (and the x25
    # grid) then runs in parallel, and the softmax / min_by / rank steps all
    # cluster on request_id, so this is the only shuffle they need.  The grid's work is
    # far larger than its rows: adaptive execution would leave it to a few tasks
    if grid:
        spark = c.sparkSession
        c = c.repartition(max(task_slots(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), "request_id")
    else:
        c = c.repartition("request_id")
    c = score(c, model, keep_vector=grid)
    # the lowest run value is the most probable: one order serves the softmax and
    # the ranks, so a task sorts its candidates once
    best = Window.partitionBy("request_id").orderBy("predicted_rv", "arsenal_pos")
    req = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    neg = -F.col("predicted_rv")
    c = c.withColumn("_e", F.exp(neg - F.max(neg).over(req)))
    c = c.withColumn("probability", F.col("_e") / F.sum("_e").over(req)).drop("_e")
    c = c.withColumn("current_re", run_expectancy("outs", "on_1b", "on_2b", "on_3b"))
    if grid:
        c = optimize_vectors(c, zone_long, model)
    else:
        fb = K.FALLBACK_LOCATION
        c = c.withColumn("location", F.struct(
            F.lit(fb["plate_x"]).alias("plate_x"), F.lit(fb["plate_z"]).alias("plate_z"),
            F.lit(fb["zone"]).cast("long").alias("zone"), F.lit(fb["in_zone"]).alias("in_zone"),
            F.lit(fb["expected_rv"]).alias("expected_rv")))
    c = c.withColumn("rank", F.row_number().over(best))
    out = c.select(
        "request_id", "rank", "pitch_type", F.col("pitch_category").alias("category"), "predicted_rv",
        (F.col("current_re") + F.col("predicted_rv")).alias("expected_re_after"),
        "probability", (F.col("probability") * 100).alias("probability_pct"),
        F.col("batter_whiff_rate_vs_this_cat").alias("batter_whiff_rate"),
        F.col("batter_chase_rate_vs_this_cat").alias("batter_chase_rate"),
        F.col("batter_xwoba_vs_this_cat").alias("batter_xwoba"),
        reasoning(F.col("pitch_category"), F.col("batter_whiff_rate_vs_this_cat"),
                  F.col("batter_chase_rate_vs_this_cat"), F.col("batter_xwoba_vs_this_cat"),
                  F.col("balls"), F.col("strikes")).alias("reasoning"),
        F.col("location.plate_x").alias("loc_plate_x"), F.col("location.plate_z").alias("loc_plate_z"),
        F.col("location.zone").alias("loc_zone"), (F.col("location.in_zone") == 1).alias("loc_in_zone"),
        F.col("location.expected_rv").alias("loc_expected_rv"),
        location_label(F.col("location.plate_x"), F.col("location.plate_z")).alias("location_label"),
    )
    if top_n:
        out = out.filter(F.col("rank") <= top_n)
    return out


# R9 ------------------------------------------------------------------------
def legacy_summary(recs: DataFrame) -> DataFrame:
    """Best pitch, its run value, and the pitch -> run value map per request."""
    return recs.groupBy("request_id").agg(
        F.min_by("pitch_type", "rank").alias("best_pitch"),
        F.min_by("predicted_rv", "rank").alias("best_rv"),
        # duplicate types (two-handed pitchers) carry identical values: dedupe
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("pitch_type", "predicted_rv")))).alias("predictions"),
        F.count(F.lit(1)).alias("options"))


# R15 -----------------------------------------------------------------------
def model_table(recs: DataFrame) -> DataFrame:
    """What a screen shows of a request: each pitch type once with its run value
    and the run expectancy after it, best (lowest) first."""
    one = recs.groupBy("request_id", "pitch_type").agg(F.min("predicted_rv").alias("expected_run_value"), F.min("expected_re_after").alias("expected_after_re"))
    w = Window.partitionBy("request_id").orderBy("expected_after_re", "pitch_type")
    return one.withColumn("place", F.row_number().over(w))
