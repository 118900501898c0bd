"""Benchmark: seconds per headline operator on the pitch view.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line.  Every timing runs the full plan to a no-op sink
(``write.format('noop')``), so nothing is collected to the driver.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from moundflow.operators import analytics as AN  # noqa: E402
from moundflow.operators import heuristic as HE  # noqa: E402
from moundflow.operators import model as ML  # noqa: E402
from moundflow.operators import recommend as RE  # noqa: E402
from moundflow.plans.tables import Tables  # noqa: E402
from moundflow.session import local_session  # noqa: E402
from moundflow.sources import requests as RQ  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
GBT_ITER = int(os.environ.get("BENCH_GBT_ITER", "200"))
N_REQUESTS = int(os.environ.get("BENCH_REQUESTS", "0"))


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = local_session(cores=CPUS, shuffle_partitions=int(CPUS) * 2, app="moundflow-bench")
    timings = {}
    # the raw pitch log is an input file in production: derive it from the
    # driver's tables once and write it to the checkpoint folder (untimed)
    t0 = time.time()
    raw = Tables(spark, SF_DIR).raw.checkpoint()
    load_s = round(time.time() - t0, 3)
    t = Tables(spark, SF_DIR, raw=raw)

    def timed(name, fn):
        t0 = time.time()
        fn()
        timings[name] = round(time.time() - t0, 3)

    # warm-up on the smallest scale: JIT and codegen caches, as on a
    # long-running cluster (not timed)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        w = Tables(spark, warm_dir)
        for df in (w.pitches, w.batter_wide, w.pitcher_arsenals, w.zone_wide, w.features):
            run(df)
        run(RE.recommend(RQ.requests(spark, warm_dir), w.pitcher_arsenals, w.pitcher_profiles, w.batter_wide))

    # each pipeline step is built and materialised once (as a job writes its
    # output); later steps read the materialised tables
    timed("pitches_with_rv", lambda: t.materialize("pitches"))
    timed("batter_profiles", lambda: (t.materialize("batter_profiles"), t.materialize("batter_wide")))
    timed("pitcher_profiles", lambda: (t.materialize("pitcher_profiles"), t.materialize("pitcher_arsenals")))
    timed("batter_zone_profiles", lambda: (t.materialize("zone_long"), run(t.zone_wide)))
    timed("features", lambda: t.materialize("features"))
    timed("baseline_backoff", lambda: run(AN.baseline_lookup(t.pitches.withColumn("count", AN.count_text()),
                                                             AN.baseline_table(t.pitches))))
    timed("eprv_outcome_tables", lambda: run(AN.eprv_by_context(AN.outcome_distribution(t.pitches),
                                                                AN.outcome_rv_table(t.pitches))))
    feats, arsenals, profiles = t.features, t.pitcher_arsenals, t.pitcher_profiles
    wide, zones = t.batter_wide, t.zone_long

    model_box = {}

    def fit():
        model_box["m"] = ML.train(feats, max_iter=GBT_ITER)

    timed(f"gbt_fit_iter{GBT_ITER}", fit)
    model, _, _, split_df = model_box["m"]
    quality = {}

    def metrics():
        scored = ML.predict(model, split_df, "prediction").checkpoint()
        for r in ML.regression_metrics(scored).collect():          # 3 rows
            quality[r.split] = {"n": r.n, "rmse": round(r.rmse, 5), "mae": round(r.mae, 5), "r2": round(r.r2, 5)}
        rq = ML.ranking_quality(scored.filter(F.col("split") == "test")).first()
        quality["ranking"] = {"pct_better_than_avg": round(rq.pct_better_than_avg, 2),
                              "avg_rv_improvement": round(rq.avg_rv_improvement, 5), "at_bats": rq.at_bats}

    timed("gbt_metrics", metrics)
    quality["trees"] = model.stages[-1].getNumTrees

    quality["sec_per_tree"] = round(timings[f"gbt_fit_iter{GBT_ITER}"] / max(1, quality["trees"]), 2)
    all_reqs = RQ.requests(spark, SF_DIR)
    timed("recommend_all_requests_model_no_grid",
          lambda: run(RE.recommend(all_reqs, arsenals, profiles, wide, zones, model=model, optimize_location=False)))
    # the 25-cell grid: all requests, or BENCH_REQUESTS of them
    reqs = all_reqs.orderBy("request_id").limit(N_REQUESTS).checkpoint() if N_REQUESTS else all_reqs
    timed(f"recommend_{N_REQUESTS or 'all'}_grid",
          lambda: run(RE.recommend(reqs, arsenals, profiles, wide, zones, model=model, optimize_location=True)))
    timed("recommend_all_requests_no_model",
          lambda: run(RE.recommend(all_reqs, arsenals, profiles, wide, zones)))
    timed("heuristic_sequence_all_requests",
          lambda: run(HE.recommend_sequence(all_reqs, RQ.archetypes(spark, t.raw.select("batter")),
                                            AN.distinct_arsenal(t.raw), key="batter_query")))

    # registered queries as they are: nothing materialised between steps
    from moundflow.plans.queries import REGISTRY
    for name in ("f09_features", "r05_recommend", "r10_heuristic_candidates", "t01_atbat_fold"):
        timed(f"query_{name}", lambda: run(REGISTRY[name].spark(spark, SF_DIR)))

    total = round(sum(timings.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_operator_seconds", "value": total, "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": CPUS, "raw_log_build_sec": load_s,
                      "model_quality": quality}))
    spark.stop()


if __name__ == "__main__":
    main()
