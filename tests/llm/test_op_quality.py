"""Operators 6 and 7: counts against brute force, held-out accuracy."""
import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moundflow.llm import importance as I
from moundflow.llm import quality_rules as Q

DIR = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


def test_counts(spark):
    rows = brute.awkward() + [(1, "a\nb\na\n a\na\n\n\n"), (2, "#$% <|>&* " * 12), (3, "a b c d e f g h " * 3 + "x" * 50_000), (None, "w " * 25)]
    none = Q.Model(np.zeros(1 << Q.BITS), 30.0)
    out = sorted((tuple(r)[:7] for r in Q.judge(brute.frame(spark, rows), none).collect()), key=str)
    assert out == sorted(((i, *brute.base_counts(t)) for i, t in rows), key=str)


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0
    model = Q.train(docs, labels.where(~fold))
    held = Q.judge(docs, model).join(labels.where(fold), "doc_id").where("not base_failed").toPandas()
    assert ((held.probability >= Q.THRESHOLD) == (held.quality == 1)).mean() > 0.95
    assert held[held.quality == 1].kept.mean() > 0.98
    # calibrated: the mean probability is about the share of good texts
    assert abs(held.probability.mean() - held.quality.mean()) < 0.1


def test_fit_does_not_depend_on_partitions(spark):
    docs, labels = tables(spark)
    a = Q.train(docs, labels, max_rows=150)
    b = Q.train(docs.repartition(5), labels.repartition(3), max_rows=150)
    assert np.array_equal(a.weights, b.weights) and (a.a, a.b, a.bias) == (b.a, b.b, b.bias)


def test_labels_of_one_class_or_none(spark):
    docs, labels = tables(spark)
    for some in (labels.where("false"), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        out = Q.judge(docs, Q.train(docs, some)).toPandas()
        assert (out.kept == ~out.base_failed).all()
    assert Q.judge(docs.where("false"), Q.Model(np.zeros(1 << Q.BITS), 0.0)).count() == 0


def test_importance_separates_labelled_texts(spark):
    docs, labels = tables(spark)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0
    ratio, least = I.fit_all(docs, labels.where(~fold))
    held = I.weigh(docs.select("doc_id", "text"), ratio).join(labels.where(fold), "doc_id").toPandas()
    held["kept"] = held["__key"] >= least
    assert held[(held.quality == 1) & (held.toxic == 0)].kept.mean() > 0.99
    assert held[held.quality == 0].kept.mean() < 0.3


def test_ratio_is_that_of_the_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c, c"), (3, None), (1, "a b a")], "doc_id long, text string")
    ratio = I.fit(docs, spark.createDataFrame([(1, 1.0), (2, 0.0)], "doc_id long, y double"), smooth=1.0)
    text = b"a b ac, c"
    b, owner = I.grams(np.frombuffer(text, np.uint8), np.array([0, 5, 9]))
    one, two = b[owner == 0], b[owner == 1]
    assert len(one) == 5 and len(two) == 5      # words, marks, pairs
    assert (ratio[one] > 0.3).all() and (ratio[np.setdiff1d(two, one)] < -0.5).all()


def test_resample_keeps_columns_and_reruns_agree(spark):
    rows = brute.awkward() + [(None, "no id"), (4, None), (4, None)]
    docs = brute.frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, None) for i, _ in rows[20:60] if i is not None] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    out = I.resample(docs, labels)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, I.resample(docs.repartition(5), labels).collect()))
    assert I.resample(docs, labels.where("false")).count() == len(rows)
    assert I.resample(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("k", [0, 1, 7, 50, 99, 100, 500])
def test_gumbel_top_k(spark, k):
    r = np.random.default_rng(3)
    keys = np.round(r.normal(size=100) * 5, 1)      # with ties
    df = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(100), "__key": keys}))
    df = df.unionByName(spark.createDataFrame([(None, None)], df.schema))
    got = sorted((x["__key"] for x in I.gumbel_top_k(df, k, bins=8).collect()), reverse=True)
    assert got == sorted(keys, reverse=True)[:k]


def test_gumbel_noise_has_its_distribution(spark):
    x = spark.range(20_000).select(I.gumbel(F.col("id"), F.lit("t"), 1).alias("g")).toPandas().g
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.std() - 1.2825) < 0.05


def test_top_k_is_exactly_k_and_marked(spark):
    from pyspark.sql import functions as F
    rows = [(i, float(i % 7), f"t{i % 14}") for i in range(60)] + [(99, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, `k.e` double, t string")
    for k in (0, 1, 5, 30, 59, 60, 70):
        top = I.gumbel_top_k(df, k, bins=3, key="k.e")
        marked = I.mark_top_k(df, k, "kept", bins=3, key="k.e")
        want = sorted((r[1] for r in rows if r[1] is not None), reverse=True)[:k]
        assert sorted((r["k.e"] for r in top.collect()), reverse=True) == want
        got = marked.collect()
        assert len(got) == len(rows) and sorted((r["k.e"] for r in got if r["kept"]), reverse=True) == want
    assert marked.where(F.col("kept").isNull()).count() == 0


def test_query_takes_the_k_largest_keys(spark, small_dir):
    from moundflow.llm import queries, toxic
    got = queries.op7_quality_classifier(spark, small_dir).collect()
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    ratio, least = I.fit_all(docs, labels)
    judged = I.weigh(docs.select("doc_id", "text"), ratio, toxic=toxic.fit(docs, labels)).collect()
    clean = [r for r in judged if not r["__toxic"]]
    k = sum(r["__weight"] >= least for r in clean)
    assert len(got) == len(judged) and sum(r.kept for r in got) == k > 0
    assert sorted((r.key for r in got if r.kept), reverse=True) == sorted((r["__key"] for r in clean), reverse=True)[:k]
