"""R6 with a fitted model, checked against brute force: every candidate's
25 cells scored through an independent path (grid table join, per-cell
scoring), first minimum picked in Python."""
from pyspark.sql import functions as F

from moundflow.functions.location import loc_horizontal_scoring, loc_vertical_scoring, location_grid
from moundflow.operators import model as ML
from moundflow.operators import recommend as RE
from moundflow.plans.tables import Tables
from moundflow.sources import requests as RQ


def test_location_grid_matches_brute_force(spark, small_dir):
    t = Tables(spark, small_dir)
    model, _, _, _ = ML.train(t.features, max_iter=4, max_depth=4)
    reqs = RQ.requests(spark, small_dir).filter(F.col("request_id") % 97 == 1)   # a few requests for the check
    recs = RE.recommend(reqs, t.pitcher_arsenals, t.pitcher_profiles, t.batter_wide, t.zone_long,
                        model=model, optimize_location=True).collect()
    assert recs and all(r.loc_zone is not None for r in recs)

    # brute force: same candidates, each joined with the 25-row grid table
    c = RE.candidate_features(RE.attach_pitcher(RE.attach_batter(
        RE.resolve_arsenal(reqs, t.pitcher_arsenals, t.pitcher_profiles), t.batter_wide), t.pitcher_profiles))
    grid = location_grid(spark)
    g = c.join(F.broadcast(grid), how="inner", on=F.lit(True))
    z = t.zone_long.select(F.col("batter").alias("_b"), F.col("zone").cast("long").alias("_z"),
                           *[F.col(s).alias(f"batter_{s}_at_zone") for s in ["swing_rate", "whiff_rate",
                                                                             "contact_rate", "xwoba"]])
    g = g.join(z, (F.col("batter") == F.col("_b")) & (F.col("zone").cast("long") == F.col("_z")), "left")
    g = g.withColumns({"loc_horizontal": loc_horizontal_scoring("plate_x"), "loc_vertical": loc_vertical_scoring("plate_z"),
                       "batter_swing_rate_at_zone": F.coalesce("batter_swing_rate_at_zone", F.lit(0.5)),
                       "batter_whiff_rate_at_zone": F.coalesce("batter_whiff_rate_at_zone", F.lit(0.25)),
                       "batter_contact_rate_at_zone": F.coalesce("batter_contact_rate_at_zone", F.lit(0.75)),
                       "batter_xwoba_at_zone": F.coalesce("batter_xwoba_at_zone", F.lit(0.32))})
    scored = ML.predict(model, g, "cell_rv").select("request_id", "arsenal_pos", "cell_no", "plate_x", "plate_z",
                                                     "zone", "cell_rv").collect()
    best = {}
    for r in sorted(scored, key=lambda r: (r.request_id, r.arsenal_pos, r.cell_rv, r.cell_no)):
        best.setdefault((r.request_id, r.arsenal_pos), r)
    by_type = {}
    for r in c.select("request_id", "arsenal_pos", "pitch_type").collect():
        by_type.setdefault((r.request_id, r.pitch_type), []).append(r.arsenal_pos)
    for r in recs:
        cands = [best[(r.request_id, p)] for p in by_type[(r.request_id, r.pitch_type)]]
        assert any(abs(b.cell_rv - r.loc_expected_rv) < 1e-9 and b.plate_x == r.loc_plate_x
                   and b.plate_z == r.loc_plate_z and b.zone == r.loc_zone for b in cands)


def test_candidates_are_sorted_once(spark, small_dir):
    """One order serves the softmax and the ranks."""
    from moundflow.plans import queries as Q
    from moundflow.plans.tables import Tables
    plan = Q._recommend(Tables(spark, small_dir))._jdf.queryExecution().executedPlan().toString()
    by_request = [x for x in plan.split("\n") if " Sort [request_id" in x]
    assert len(by_request) == 1 and "Window" in plan


def test_scored_candidates_are_not_moved_again(spark, small_dir):
    """R6 with a model: the last exchange deals candidates by request, over tasks for the
    grid's work; vectors and cells are neither moved nor sorted after it."""
    t = Tables(spark, small_dir)
    model, _, _, _ = ML.train(t.features, max_iter=1, max_depth=2)
    recs = RE.recommend(RQ.requests(spark, small_dir), t.pitcher_arsenals, t.pitcher_profiles, t.batter_wide, t.zone_long, model=model)
    plan = recs._jdf.queryExecution().executedPlan().toString().splitlines()
    last = next(i for i, line in enumerate(plan) if "Exchange " in line)
    assert "REPARTITION_BY_NUM" in plan[last] and "hashpartitioning(request_id" in plan[last]
    assert not [x for x in plan[:last] if "SortAggregate" in x or "Join" in x]
