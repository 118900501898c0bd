"""Exact quantiles of many columns against NumPy, and the rounds they take."""
import numpy as np
import pytest

from moundflow.operators import order_stats as OS


@pytest.mark.parametrize("few", [4, 512])
def test_exact_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(OS, "FEW", few)
    rnd = np.random.default_rng(3)
    n = 3000
    cols = {"normal": rnd.normal(size=n), "ints": rnd.integers(0, 7, n).astype(float), "wide": 10.0 ** rnd.uniform(-30, 30, n),
            "same": np.full(n, 2.5), "close": 1 + rnd.integers(0, 50, n) * 2.0**-52, "far": np.where(rnd.random(n) < 0.5, -1.7e308, 1.7e308),
            "a.b": rnd.random(n)}
    rows = [tuple(float(cols[c][i]) if (i + j) % 5 else (None if i % 2 else float("nan")) for j, c in enumerate(cols)) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols) + ", empty double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = OS.exact_quantiles(df, [*cols, "empty"], qs)
    assert got.pop("empty") == [None] * 5
    for j, c in enumerate(cols):
        kept = [r[j] for r in rows if r[j] is not None and r[j] == r[j]]
        if c == "far":
            continue
        assert got[c] == pytest.approx([float(np.quantile(kept, q)) for q in qs], rel=1e-15), c
        assert got[c][0] == min(kept) and got[c][-1] == max(kept)
    assert got["far"][0] == -1.7e308 and got["far"][-1] == 1.7e308


def test_median_of_even_counts_and_no_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (None,), (4,)], "a int")
    assert OS.exact_quantiles(df, ["a"], [0.5]) == {"a": [3.0]}
    assert OS.exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]} and OS.exact_quantiles(df, [], [0.5]) == {}


def test_settled_columns_are_not_read_again(spark, monkeypatch):
    """A pass makes no row a value, and reads the columns only that are still open."""
    read, plans = [], []
    own, rnd = OS._histogram, np.random.default_rng(5)

    def seen(d, ranges):
        read.append(list(d.columns))
        plans.append(d)
        return own(d, ranges)
    monkeypatch.setattr(OS, "_histogram", seen)
    x = rnd.normal(size=4000)
    df = spark.createDataFrame([(float(v), int(v > 0), 3.0, -0.0 if i % 2 else 0.0) for i, v in enumerate(x)], "x double, flag int, same double, zero double")
    got = OS.exact_quantiles(df, df.columns, [0.5])
    assert got == {"x": [pytest.approx(float(np.median(x)), rel=1e-15)], "flag": [float(np.median(x > 0))], "same": [3.0], "zero": [0.0]}
    assert read[0] == ["c0", "c1", "c2", "c3"] and len(read) > 1
    assert all(names == ["c0"] for names in read[1:])
    counted = OS._counted([(0, *OS.WHOLE, 0, OS.POWERS, False)])
    cells = plans[-1].mapInArrow(counted, "k int, b long, n long, lo long, hi long, values array<long>")
    assert "Generate" not in cells._jdf.queryExecution().executedPlan().toString()
    assert cells.agg({"n": "sum"}).first()[0] == 4000 and cells.count() < 400
