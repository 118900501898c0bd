"""Each stage works on what the one before kept, held against brute force."""
import brute
import pytest

import __spark_entry__ as E
import corpus_pipeline as P


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = "/root/testdata/sf0.001"
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{d}/documents.parquet")]
    for name, stage in P.STAGES:
        stage(spark, out[-1], d).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_classifier_keeps_clean_rejects_bad(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in P.quality_classifier(spark, docs, "/root/testdata/sf0.01").collect()}
    lab = labels.toPandas()
    clean, bad = lab[(lab.quality == 1) & (lab.toxic == 0)].doc_id, lab[lab.quality == 0].doc_id
    assert clean.isin(kept).mean() > 0.99 and bad.isin(kept).mean() < 0.2
    assert set(rows(stages[1])) < set(rows(stages[0]))


def test_line_stage(stages):
    want = [(i, t if k else old) for (i, old), (_, _, k, t) in zip(rows(stages[1]), brute.dedup_lines(rows(stages[1])))]
    assert rows(stages[2]) == want


def test_near_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    group = brute.components([brute.fingerprint(t) for _, t in before])
    assert after == [before[k] for k in sorted(set(group))]


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    bad = {i for i, *_, hit in brute.contamination(rows(stages[3]), items) if hit}
    assert rows(stages[4]) == [r for r in rows(stages[3]) if r[0] not in bad]


def test_mixing_stage(stages):
    got = {r["doc_id"]: r for r in stages[5].collect()}
    assert {i: r["size"] for i, r in got.items()} == {i: len(brute.words(t)) for i, t in rows(stages[4])}
    assert all(r["taken"] <= 2 * r["size"] for r in got.values())


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(str, P.run(spark, "/root/testdata/sf0.001").collect())) == sorted(map(str, stages[5].collect()))


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
