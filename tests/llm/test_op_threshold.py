"""Operator 7: the cut between labelled target and rejected rows."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moundflow.llm import importance as I


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_rejected_rows_go_at_any_size(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(3)) == 0
    ratio, least = I.fit_all(docs, labels.where(~fold))
    held = I.weigh(docs.select("doc_id", "text"), ratio).join(labels.where(fold), "doc_id").toPandas()
    kept = held["__key"] >= least
    assert kept[(held.quality == 1) & (held.toxic == 0)].mean() > 0.985
    assert kept[held.quality == 0].mean() < 0.03


def test_smoothing_follows_the_labels():
    r = np.random.default_rng(2)
    raw, target = r.integers(1, 10**6, I.BUCKETS), r.integers(0, 50, I.BUCKETS)
    assert np.allclose(I.log_ratio(raw, target), I.log_ratio(raw * 100, target * 100), atol=1e-3)


def test_one_outlier_does_not_set_the_cut():
    y = np.r_[np.ones(400), np.zeros(50)]
    weight = np.r_[-500.0, np.linspace(50, 200, 399), np.linspace(-100, -20, 50)]
    held = pa.table({"y": y, "noise": np.zeros(450), "weight": weight, "n": np.full(450, 100)})
    gap, least = I.threshold(held)
    key = weight + gap * 100
    assert (key[y == 0] < least).all() and (key[y == 1] >= least).sum() == 399


def test_a_repeated_word_is_not_many_good_pairs():
    for text in (b"es es es es es es", b"Es. Es. Es. Es. Es. Es."):
        other = text.lower().replace(b"es", b"la")
        a, b = (set(I.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for t in (text, other))
        assert 0 in a & b
