import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from moundflow.llm import simhash as S


def test_fingerprints(spark):
    rows = brute.awkward()
    out = sorted((r["doc_id"], r["fp"] % (1 << 64)) for r in S.fingerprint_rows(brute.frame(spark, rows)).collect())
    assert out == sorted((i, brute.fingerprint(t)) for i, t in rows)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_distances_on_planes(radius):
    r = np.random.default_rng(radius)
    v = r.integers(0, 1 << 63, 130).astype(np.uint64)
    v[1::2] = v[::2] ^ (np.uint64(1) << r.integers(0, 63, 65).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 65).astype(np.uint64))
    hits = {(i, int(j)) for i, near in S.within(v, S.bit_planes(v), len(v), radius) for j in near}
    assert hits == {(i, j) for i in range(130) for j in range(130) if (int(v[i]) ^ int(v[j])).bit_count() <= radius}


@pytest.mark.parametrize("max_group", [S.MAX_GROUP, 4])
def test_components_equal_all_pairs(spark, max_group):
    r = random.Random(4)
    fps = [0, (1 << 64) - 1, 7]
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 12)):     # chains: neighbours are near, ends are not
            fps.append(x)
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    root = {r["node"]: r["root"] for r in S.components(S.links(df, 3, max_group)).collect()}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    mine = [root.get(f, f) for f in signed]
    want = brute.components(fps)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_pair_keys_miss_nothing():
    r = random.Random(1)
    masks = S.key_masks(3)
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << r.randrange(64)
        shared = [m for m in masks if not (a ^ b) & m % (1 << 64)]
        assert shared and any(not (a ^ b) & s % (1 << 64) for s in S.sub_masks(shared[0], 3))


def test_near_duplicates_and_keep_one(spark):
    r = random.Random(8)
    rows = brute.awkward() + [(2000, None), (2000, None), (None, "only here and nowhere else at all"), (None, "another one without any id, alone")]
    base = [f"w{r.randrange(900)}" for _ in range(300)]
    for i in range(30):
        w = list(base)
        w[r.randrange(300)] = "changed"
        rows.append((3000 + i, " ".join(w)))
    docs = brute.frame(spark, rows)
    fps = [brute.fingerprint(t) for _, t in rows]
    group = brute.components(fps)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    key = lambda x: tuple((y is not None, y) for y in x)
    out = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in S.near_duplicates(docs).collect()), key=key)
    assert out == sorted(((i, f, least.get(g)) for (i, _), f, g in zip(rows, fps, group)), key=key)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(group)) and sorted(x for x in ids if x is not None) == sorted(least.values())


def test_empty_table(spark):
    docs = brute.frame(spark, [(1, "a")]).where("doc_id < 0")
    assert S.near_duplicates(docs).count() == 0 and S.keep_one(docs).count() == 0


def test_one_fingerprint_on_a_third_of_the_rows(spark):
    """Blank rows are one group with the smallest of their ids, next to many others."""
    rows = [(i, "  " if i % 3 == 0 else f"word{i % 400} and{i % 397} more{i % 391} text{i % 389}") for i in range(3000)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()
    blank = [r for r in got if r.fp == 0]
    assert len(got) == 3000 and len(blank) == 1000 and {r.component_id for r in blank} == {0}
