import brute
import pytest

from moundflow.llm import decontaminate as D

ITEMS = [(1, "One two three four FIVE six seven eight nine ten eleven twelve."), (2, "short item"), (3, None), (None, "no id here, but words that hit a text"),
         (4, "..."), (5, "one two three four five six seven eight nine ten"), (5, "short item"), (10, "é1 ünï 2"), (6, "lone")]
TEXTS = [(1, "x ONE, two-three four five\nsix seven eight nine ten eleven zzz"), (2, "a short, item and a short item"), (3, None), (4, ""),
         (5, "no id here but words that hit a text"), (6, "É1 ünï 2 é1 ünï 2"), (7, "short\titemized"), (7, "short\titemized"), (None, "a lone word"),
         (8, "one two three four five six seven eight nine"), (9, "clean words only " * 3000), (10, "lone" * 500 + " lone")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 700])
def test_hits(spark, block):
    rows = TEXTS + brute.awkward()
    items = ITEMS + [(100 + i, t) for i, t in brute.awkward(9, 2)]
    out = D.digest(D.find_hits(brute.frame(spark, rows), bench(spark, items), block_bytes=block))
    assert got(out) == sorted(brute.contamination(rows, items), key=str)


def test_production_window_over_generated_texts(spark, small_dir):
    docs, items = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(D.digest(D.find_hits(docs, items))) == sorted(want, key=str)


def test_remove_and_cut(spark):
    docs = brute.frame(spark, TEXTS)
    dirty = {i for i, *_, bad in brute.contamination(TEXTS, ITEMS) if bad}
    kept = D.decontaminate(docs, bench(spark))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _ in TEXTS if i not in dirty), key=str)
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, bench(spark), "cut").collect()}
    assert cut[1] == "x  zzz" and cut[2] == "a  and a " and cut[3] is None and cut[7] == "short\titemized" and len(cut) == len({i for i, _ in TEXTS})
    assert not any(r["contaminated"] for r in D.digest(D.find_hits(D.decontaminate(docs, bench(spark), "cut"), bench(spark, ITEMS[:1]))).collect())
    with pytest.raises(ValueError):
        D.decontaminate(docs, bench(spark), "other")


def test_empty_tables(spark):
    docs = brute.frame(spark, TEXTS)
    assert D.find_hits(docs.where("false"), bench(spark)).count() == 0
    none = D.digest(D.find_hits(docs, bench(spark).where("false"))).collect()
    assert len(none) == len(TEXTS) and not any(r["contaminated"] for r in none)
    assert D.decontaminate(docs, bench(spark).where("false")).count() == len(TEXTS)


@pytest.mark.parametrize("block", [8, 60, 1 << 20])
def test_cut_is_the_same_for_any_blocks(spark, block):
    """Overlapping items in several blocks: all are judged on the input."""
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[5:15])), (2, " ".join(words[10:20])), (3, " ".join(words[30:33])), (4, "not here at all")]
    rows = [(1, " ".join(words)), (2, None), (3, "w1 w2"), (1, " ".join(words)), (4, "W30,\tw31;w32!")]
    docs = brute.frame(spark, rows)
    cut = D.decontaminate(docs, bench(spark, items), "cut", block_bytes=block)
    assert cut.columns == docs.columns
    kept = " ".join(words[:5]) + "  " + " ".join(words[20:30]) + "  " + " ".join(words[33:])
    assert sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str) == sorted([(1, kept), (1, kept), (2, None), (3, "w1 w2"), (4, "!")], key=str)
