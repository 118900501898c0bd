"""Additive profiles: merged partial counts equal a full recompute, and the
same aggregate runs as a Structured Streaming query."""
import os
import tempfile

from pyspark.sql import functions as F

from moundflow.operators import profiles as PR
from moundflow.plans.tables import Tables


def _rows(df):
    return sorted(tuple(r) for r in df.select("batter", "pitch_category", *PR.COUNT_COLS).collect())


def test_merge_equals_full(spark, small_dir):
    raw = Tables(spark, small_dir).raw
    early = raw.filter(F.col("game_date") < F.lit("2024-06-01").cast("date"))
    late = raw.filter(F.col("game_date") >= F.lit("2024-06-01").cast("date"))
    merged = PR.merge_batter_counts(PR.batter_category_counts(early), PR.batter_category_counts(late))
    full = PR.batter_category_counts(raw)
    assert _rows(merged) == _rows(full)


def test_streaming_counts_equal_batch(spark, small_dir):
    raw = Tables(spark, small_dir).raw
    d = tempfile.mkdtemp(prefix="moundflow-inc-")
    src = os.path.join(d, "src")
    for i, (lo, hi) in enumerate([("2024-01-01", "2024-05-01"), ("2024-05-01", "2024-07-01"), ("2024-07-01", "2025-01-01")]):
        raw.filter((F.col("game_date") >= F.lit(lo).cast("date")) & (F.col("game_date") < F.lit(hi).cast("date"))) \
            .write.parquet(os.path.join(src, f"p{i}"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    q = (PR.batter_category_counts(stream).writeStream.outputMode("complete").format("memory")
         .queryName("inc_counts").option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    assert _rows(spark.table("inc_counts")) == _rows(PR.batter_category_counts(raw))
