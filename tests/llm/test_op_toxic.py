"""Operator 7: labelled toxic rows go, clean rows stay."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from moundflow.llm import importance as I
from moundflow.llm import toxic as T


def test_held_out_toxic_rows_go_and_clean_rows_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(3)) == 0
    some = docs.join(labels.where(fold & (F.col("quality") == 1)), "doc_id", "left_semi")
    ratio, least = I.fit_all(docs, labels.where(~fold))
    kept = I.weigh(some, ratio, least=least, toxic=T.fit(docs, labels.where(~fold))).select("doc_id").withColumn("kept", F.lit(1))
    got = labels.where(fold & (F.col("quality") == 1)).join(kept, "doc_id", "left").toPandas()
    assert got[got.toxic == 1].kept.notna().mean() < 0.03
    assert got[got.toxic == 0].kept.notna().mean() > 0.985


def test_one_strong_word_is_not_outweighed_by_good_text(spark):
    r = np.random.default_rng(1)
    words = np.array([f"{a}{b}ing" for a in "bdfgklmn" for b in "aeiou"])
    good = [" ".join(r.choice(words, 400)) for _ in range(80)]
    rows = [(i, t if i % 4 else t + " Vileword" + " scurvy" * (i % 3 == 0)) for i, t in enumerate(good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    assert {x.doc_id for x in I.resample(docs, labels).collect()} == {i for i in range(80) if i % 4}


def test_labels_without_toxic_or_target_rows(spark):
    docs = spark.createDataFrame([(1, "a few words"), (2, None), (None, "no id")], "doc_id long, text string")
    for rows in ([(1, 1, 0)], [(1, 0, 1)], [(2, None, None)], []):
        table = T.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert table.cut == float("inf") and len(table.hashes) == 0


@pytest.mark.parametrize("good,bad,cut,lost,kept", [([1, 5, 6], [], 1, 0, 0), ([5, 6, 7], [1, 2], 3.5, 0, 0), ([0, 5, 6, 7], [1, 2], 3.5, 1, 0), ([], [1], float("-inf"), 0, 1)])
def test_cut_between_two_classes(good, bad, cut, lost, kept):
    good, bad = np.array(good, float), np.array(bad, float)
    assert T.between(good, bad, 0.25) == cut
    assert (good < cut).sum() == lost and (bad >= cut).sum() == kept
