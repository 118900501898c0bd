"""Operator 5: words taken from tiny and from many sources."""
import math
from collections import defaultdict

import pytest

from moundflow.llm import mixing as M


@pytest.mark.parametrize("sizes", [[10, 20, 65, 130, 193, 1, 64, 5000], [(7 * i) % 300 + 1 for i in range(2000)]])
@pytest.mark.parametrize("share", [1.5, 2.0])
def test_every_source_takes_its_target(spark, sizes, share):
    rows = [(i * 10 + j, "w " * n, f"s{i}") for i, size in enumerate(sizes) for j, n in enumerate((size // 3, size - size // 3)) if n]
    out = M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=share)[2].collect()
    taken, target = defaultdict(int), {}
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        taken[r["doc_id"] // 10] += r["taken"]
        target[r["doc_id"] // 10] = r["target"]
    assert len(target) == len(sizes)
    assert all(abs(taken[i] - target[i]) <= 0.5 + 1e-6 for i in target)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 6, 89, 90, 12_345, 10**6, 10**9 + 8])
def test_step_meets_every_place_evenly(n):
    p = M.golden_step(n)
    assert n < 2 or math.gcd(p, n) == 1
    if 89 <= n <= 10**6:
        for lo, hi in ((0, n // 7), (n // 3, n // 2), (n - n // 50 - 1, n)):
            seen = 0
            for i in range(n):
                seen += lo <= i * p % n < hi
                assert abs(seen - (hi - lo) * (i + 1) / n) < 4
