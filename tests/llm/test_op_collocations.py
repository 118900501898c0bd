"""Collocations against plain counting, the summaries' guarantee, awkward texts."""
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from moundflow.llm import collocation as co

SCHEMA = "doc_id long, text string, lang string, phrase string, `a.b` string, f long"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, shortest=2, longest=3, threshold=10, inside=50, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        t = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) >= shortest and a >= threshold}
        gone = {p[i:j] for p, b in cand.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1)
                if j - i < len(p) and p[i:j] in cand and 100 * b >= inside * cand[p[i:j]]}
        rows = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def texts(n=400, seed=5):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "Éa", "x\x00", "no\xa0break", "a", "b", "😀"] + [f"w{i}" for i in range(60)]
    rows = [(None, "en"), ("", None), ("\n..\t ", "en"), ("one", "fr"), ("in the middle of " * 30, None), ("a a a a " * 40, "de"), ("la , la ; la " * 20, "de")]
    for _ in range(n):
        t = ""
        for _ in range(rnd.randrange(60)):
            t += rnd.choice(["new york city", "of the", *[rnd.choice(words[:13]), rnd.choice(words)] * 3]) + rnd.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", " \r"])
        rows.append((t, rnd.choice(["en", "en", "de", None, "und"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", "q", 1) for i, (t, lang) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("more", [{}, {"shortest": 2, "longest": 4, "threshold": 5, "inside": 70, "top": 50}])
def test_equals_plain_counts(spark, more):
    rows = texts()
    want = brute(rows, **more)
    assert len(want) > 40 and got(co.collocations(frame(spark, rows), **more)) == want


def test_small_summaries_lose_nothing(spark, monkeypatch):
    """Tight capacities over many small blocks and hash partitions: decrements happen, results stay."""
    monkeypatch.setattr(co, "BLOCK", 500)
    monkeypatch.setattr(co, "SLICE", 300)
    rows = texts(800, 9)
    df = frame(spark, rows)
    assert got(co.collocations(df, mass=2_000, slack=1)) == brute(rows)


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "FILTER_POWER", 3)
    rows = texts(100)
    assert got(co.collocations(frame(spark, rows))) == brute(rows)


def test_summary_guarantee():
    """Merged in any order, a counter loses less than mass / capacity."""
    rnd = np.random.default_rng(1)
    for threshold in (3, 10, 40):
        keys = np.concatenate([rnd.integers(0, 1 << 32, 20_000), np.repeat(rnd.integers(0, 1 << 32, 200), rnd.integers(1, 80, 200))]).astype(np.uint32)
        rnd.shuffle(keys)
        s = co.Summary(len(keys) // threshold + 1)
        for part in np.array_split(keys, 37):
            s.merge(*co.tally(part))
        true, n = np.unique(keys, return_counts=True)
        assert 0 < s.taken < threshold
        assert set(true[n >= threshold].tolist()) <= set(s.may_reach(threshold).tolist())
        assert len(s.may_reach(threshold)) < len(true)


def test_empty_table(spark):
    assert got(co.collocations(frame(spark, []))) == [] == got(co.collocations(frame(spark, [(None, None), ("", "en")])))


def test_table_equals_sql(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    sql = sorted(con.execute(co.ORACLE).fetchall())
    assert [tuple(d[0] for d in con.description)] == [tuple(COLUMNS)]
    assert got(co.collocations(docs)) == sql == brute([(r.text, r.lang) for r in docs.select("text", "lang").collect()])


def test_blocks_are_bounded_whatever_a_slice_holds(monkeypatch):
    """What is counted at once is a block, also where a slice of texts has many times its n-grams."""
    import pyarrow as pa
    n = 50_000
    words = " ".join(map(str, np.random.default_rng(4).integers(0, 1 << 30, n).tolist()))
    monkeypatch.setattr(co, "BLOCK", 1 << 14)
    masses = [sum(b.column("mass").drop_null().to_pylist()) for b in co._count_blocks(3, 2)(iter([pa.RecordBatch.from_pydict({"lang": ["en"], "text": [words]})]))]
    assert sum(masses) == 3 * n - 3 and max(masses) <= 1 << 14
