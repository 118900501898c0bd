from collections import defaultdict

import brute
import pytest

from moundflow.llm import mixing as M


def water(sizes, weights, share=1.5, cap=2):
    """Targets by resharing again and again."""
    target, total = {s: 0.0 for s in sizes}, share * sum(sizes.values())
    free = set(sizes)
    left = total
    while free and left > 1e-9:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if unit * weights[s] > cap * sizes[s]}
        if not over:
            for s in free:
                target[s] = unit * weights[s]
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def sized(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    return sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, size string, target int").repartition(3)


def rows_of(n=400, sources=("b", "a", "é", "Z", None, "c", "tiny", "void")):
    out = []
    for i in range(n):
        s = sources[0] if i % 3 == 0 else sources[i % 6]
        out.append((i, " ".join(["w"] * (i * 37 % 211 + 1)), s))
    return out + [(1000, "one", "tiny"), (1001, None, "void"), (1002, "", "a"), (2005, "repeated row", "a"), (2005, "repeated row", "a"), (None, "no id " * 20, None)]


def test_targets_sizes_and_taken(spark):
    rows = rows_of()
    plan, parts, taken = M.mix_sources(docs_of(spark, rows))
    sizes, weights = sized(rows)
    target = water(sizes, weights)
    got = taken.collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((i, len(brute.words(t))) for i, t, _ in rows if i is not None)
    source = {i: s for i, _, s in rows}      # one source per id here
    by = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        by[s] += r["taken"]
    for s in sizes:
        assert abs(by[s] - target[s]) <= 6 * M.BLOCK_WORDS, (s, by[s], target[s])
    again = M.mix_sources(docs_of(spark, rows).repartition(7))[2]
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_schedule_is_even_and_ranked(spark):
    plan, parts, _ = M.mix_sources(docs_of(spark, rows_of()))
    p = plan.orderBy("slot").collect()
    seen = defaultdict(int)
    share = defaultdict(int)
    for r in p:
        share[r["source"]] += 1
    blocks = {s: max(x["block"] for x in parts.collect() if x["source"] == s) + 1 for s in share}
    for i, r in enumerate(p):
        assert r["rank"] == seen[r["source"]]
        assert r["block"] == r["rank"] % blocks[r["source"]] and r["epoch"] == r["rank"] // blocks[r["source"]] < 2
        seen[r["source"]] += 1
        # low discrepancy: every stretch of the schedule has about the mix's shares
        for s, n in share.items():
            assert abs(seen[s] - n * (i + 1) / len(p)) < 5
    words = defaultdict(int)
    for x in parts.collect():
        words[x["source"], x["block"]] += x["words"]
    assert all(n == M.BLOCK_WORDS or b == blocks.get(s, 0) - 1 for (s, b), n in words.items() if s in blocks)


def test_chunks_and_buckets_do_not_change_the_mix(spark, monkeypatch):
    rows = rows_of(120)
    want = sorted(map(str, M.mix_sources(docs_of(spark, rows))[2].collect()))
    assert sorted(map(str, M.mix_sources(docs_of(spark, rows))[2].collect())) == want
    monkeypatch.setattr(M, "CHUNK", 7)
    monkeypatch.setattr(M, "BUCKET_ROWS", 10)
    assert sorted(map(str, M.mix_sources(docs_of(spark, rows))[2].collect())) == want


def test_share_that_takes_everything_twice(spark):
    _, _, taken = M.mix_sources(docs_of(spark, rows_of(40)), share=2.0)
    assert all(r["target"] == pytest.approx(2 * r["source_size"]) for r in taken.collect())


def test_empty_and_wordless_tables(spark):
    assert M.mix_sources(docs_of(spark, rows_of(5)).where("false"))[2].count() == 0
    out = M.mix_sources(docs_of(spark, [(1, None, "a"), (2, " ", None)]))[2].collect()
    assert [(r["size"], r["taken"], r["target"]) for r in out] == [(0, 0, 0.0)] * 2


def test_mixed_order_reads_what_is_taken(spark):
    """Slot by slot the pieces add up to each document's words; a slot's are next to each other."""
    plan, parts, taken = M.mix_sources(docs_of(spark, rows_of(150)))
    mix = M.mixed_order(plan, parts).collect()
    got, slots = defaultdict(int), defaultdict(list)
    for r in mix:
        got[r["doc_id"]] += r["words"]
        slots[r["slot"]].append((r["at"], r["words"]))
    want = defaultdict(int)
    for r in taken.collect():
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in want.items() if v} == dict(got)
    due = {r["slot"]: r["words"] for r in plan.collect()}
    assert set(slots) == set(due)
    for slot, pieces in slots.items():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at == due[slot]
