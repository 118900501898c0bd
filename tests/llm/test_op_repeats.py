"""Substring operators 3 and 10 against brute force."""
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from moundflow.llm import lpf_dedup, repeats, seed_extend


def got(df):
    return sorted(tuple(r) for r in df.collect())


@given(st.lists(st.integers(0, 2), min_size=1, max_size=80), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_suffix_order_and_longest_previous_factors(xs, depth):
    text = np.array(xs, np.uint8)
    pad = list(xs) + [0] * depth
    head = [tuple(pad[i:i + depth]) for i in range(len(xs))]
    # zeros after the end are cut as early as the end is met
    rank = lpf_dedup.suffix_ranks(text, depth)
    inside = [i for i in range(len(xs)) if i + depth <= len(xs)]
    assert [rank[i] for i in inside] == [sum(h < head[i] for h in head) for i in inside] or any(x == 0 for x in xs)
    for i in inside:
        assert {j for j in inside if rank[j] == rank[i]} == {j for j in inside if head[j] == head[i]}
    prev, after = lpf_dedup.previous_and_next(text, np.array(inside, np.int64), depth)
    for k, i in enumerate(inside):
        same = [j for j in inside if head[j] == head[i]]
        assert prev[k] == max([j for j in same if j < i], default=-1)
        assert after[k] == min([j for j in same if j > i], default=-1)


@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(0, 7))
@settings(max_examples=40, deadline=None)
def test_equal_windows_have_equal_anchors(seed, gram, more):
    r = np.random.default_rng(seed)
    values, length = r.integers(0, 3, 80).astype(np.uint64), gram + more
    off = np.array([0, 0, 30, 33, 80])
    text, s, n, o, key, _ = repeats.pieces(values, off, gram, length)
    windows = {}
    for t, a, c, at, k in zip(text, s, n, o, key):
        for i in range(c):
            w = values[a + i:a + i + length]
            windows.setdefault(w.tobytes(), set()).add((int(at) - i, int(k)))
    assert all(len(x) == 1 for x in windows.values())
    assert n.sum() == sum(max(0, b - a - length + 1) for a, b in zip(off, off[1:]))


@pytest.mark.parametrize("max_group", [256, 2, 0])
@pytest.mark.parametrize("first", [False, True])
def test_awkward_documents(spark, max_group, first):
    rows = brute.awkward()
    rows = [(i, t) for k, (i, t) in enumerate(sorted(rows))]
    docs = brute.frame(spark, rows)
    assert got(lpf_dedup.repeated_bytes(docs, 40, 9, first, max_group)) == sorted(brute.repeated_bytes(rows, 40, first))
    assert got(seed_extend.repeated_words(docs, 8, 3, first, max_group)) == sorted(brute.repeated_words(rows, 8, first))


def test_repeated_rows_are_copies(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (5, text + " more"), (None, text), (None, None)]
    docs = brute.frame(spark, rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = brute.repeated_words(rows, 35)
    assert sorted(map(tuple, seed_extend.repeated_words(docs).collect()), key=key) == sorted(want, key=key)
    want = brute.repeated_bytes(rows, 100)
    assert sorted(map(tuple, lpf_dedup.repeated_bytes(docs, 100).collect()), key=key) == sorted(want, key=key)


def test_production_parameters_on_near_copies(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(40):
        w = list(base) if i % 2 else [f"v{r.randrange(10 ** 6)}" for _ in range(100)]
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
        if i % 4 == 0:
            w = w[:30] + base[100:100 + r.randrange(30, 60)] + w[30:]
        rows.append((i, " ".join(w)))
    docs = brute.frame(spark, rows)
    assert got(seed_extend.repeated_words(docs)) == sorted(brute.repeated_words(rows, 35))
    assert got(lpf_dedup.repeated_bytes(docs)) == sorted(brute.repeated_bytes(rows, 200))


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 700)
    r = random.Random(1)
    part = "".join(r.choice("abcdef ") for _ in range(900))
    rows = [(1, "".join(r.choice("xyz ") for _ in range(2000)) + part + "q" * 900), (2, "z" + part), (3, part[:250])]
    assert got(lpf_dedup.repeated_bytes(brute.frame(spark, rows))) == sorted(brute.repeated_bytes(rows, 200))


def test_removal_keeps_columns_and_the_first_copy(spark):
    passage = " ".join(f"p{i}é" for i in range(60))
    rows = [(1, "one  " + passage + "\n two"), (2, "three " + passage), (3, None), (4, "")]
    docs = brute.frame(spark, rows)
    out = {r["doc_id"]: r for r in seed_extend.remove_repeats(docs).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "three" and out[3]["text"] is None and out[4]["text"] == ""
    out = {r["doc_id"]: r for r in lpf_dedup.remove_later_copies(docs).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "three" and out[3]["text"] is None
    assert lpf_dedup.remove_later_copies(docs).columns == docs.columns == seed_extend.remove_repeats(docs).columns


def test_empty_table(spark):
    docs = brute.frame(spark, [(1, "a")]).where("doc_id < 0")
    assert lpf_dedup.repeated_bytes(docs).count() == 0 and seed_extend.repeated_words(docs).count() == 0


@pytest.mark.parametrize("seed,depth", [(1, 3), (2, 8), (3, 20), (4, 200), (5, 11)])
def test_longest_previous_factors(seed, depth):
    """Length and source of the factors against all pairs; texts with long repeats."""
    from moundflow.llm import lpf_dedup as L
    rnd = np.random.default_rng(seed)
    part = rnd.integers(97, 99, 260).astype(np.uint8)
    text = np.concatenate([rnd.integers(97, 99, 90).astype(np.uint8), part, rnd.integers(97, 100, 40).astype(np.uint8), part[20:250], np.full(70, 97, np.uint8)])
    n = len(text)
    starts = np.sort(rnd.choice(n, 220, replace=False))
    levels = L.suffix_levels(text, depth)
    order = np.argsort(levels[-1][1][starts], kind="stable")
    places = starts[order]

    def agree(a, b):
        k = 0
        while k < depth and max(a, b) + k < n and text[a + k] == text[b + k]:
            k += 1
        return k
    for value, sign in ((places, 1), (-places, -1)):
        length, source = L.longest_previous(text, levels, places, value, depth)
        for p, m, q in zip(places, length, source):
            best = max((agree(p, x) for x in starts if sign * x < sign * p), default=0)
            assert m == best and (m == 0 or agree(p, q) == m and sign * q < sign * p)
    prev, after = L.previous_and_next(text, starts, depth)
    for p, q, r in zip(starts, prev, after):
        assert (q >= 0) == any(agree(p, x) >= depth for x in starts if x < p) and (r >= 0) == any(agree(p, x) >= depth for x in starts if x > p)


@pytest.mark.parametrize("first", [False, True])
def test_many_surroundings_are_not_taken_window_by_window(spark, first, monkeypatch):
    """A passage in very many texts: its pieces are cut by longer grams, few of them become windows."""
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(r.choice("ijklmnop ") for _ in range(300)) + passage + "".join(r.choice("ijklmnop ") for _ in range(300))) for i in range(60)]
    made = []
    keep = repeats.saved
    monkeypatch.setattr(repeats, "saved", lambda df: made.append(keep(df)) or made[-1])
    docs = brute.frame(spark, rows)
    assert got(lpf_dedup.repeated_bytes(docs, 200, 32, first, 16)) == sorted(brute.repeated_bytes(rows, 200, first))
    most = max(x.count() for x in made if {"s", "p"} & set(x.columns))
    # by windows: some 80 rows for each of the two pieces a text has that reach over the passage's ends
    assert most < 30 * len(rows)
