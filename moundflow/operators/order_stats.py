"""Exact order statistics of many columns at once.

Values are compared as 64-bit whole numbers in the same order.  Each round counts,
in one pass over the rows, how many values of every range still open fall into each
of its buckets, with the least and the greatest value met there; the bucket that
holds the wanted rank is the next range.  A task sorts its batches column by column
and keeps a bounded histogram; what is gathered a round are those histograms, never
values, until a range has few.  A column that is settled is not read again."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that number the buckets of a range, and values that are few enough to be looked at one by one.
BITS, FEW = 10, 512
#: The first range, all numbers; its buckets are the sign and the power of two.
WHOLE, POWERS = (-(1 << 63), (1 << 63) - 1), 52
#: Types that a task turns into doubles itself; with a conversion a column in its plan the
#: JVM's method would be large.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Cells that a task gathers of a range before it adds up equal buckets.
GATHERED = 1 << 14
CELLS = pa.schema([("k", pa.int32()), ("b", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("values", pa.list_(pa.int64()))])


def _ranks(n: int, q: float) -> tuple[int, int, float]:
    """The two ranks around a quantile and the weight of the second (linear interpolation)."""
    at = q * (n - 1)
    return math.floor(at), math.ceil(at), at - math.floor(at)


def _keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the numbers (no NaN; -0.0 counts as 0.0)."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(WHOLE[1]), bits)


def _value(key: int) -> float:
    bits = np.int64(key)
    return float((bits if bits >= 0 else bits ^ np.int64(WHOLE[1])).view(np.float64))


def exact_quantiles(df: DataFrame, columns: list[str], quantiles: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of each column, interpolated linearly between neighbours;
    nulls and NaN do not count, a column without values gives None.

    A round narrows a range to one of its buckets and that to the values met in
    it, so it ends where the values are equal or few."""
    if not columns:
        return {}
    plain, types = [F.col("`" + c.replace("`", "``") + "`") for c in columns], dict(df.dtypes)
    d = df.select(*[(v if types.get(c) in NUMBERS else v.cast("double")).alias(f"c{i}") for i, (c, v) in enumerate(zip(columns, plain))])
    first = _histogram(d, [(i, *WHOLE, -1) for i in range(len(columns))])
    count = [sum(n for n, *_ in cells) for cells in first]
    wanted = {(i, rank): _narrowed(first[i], rank, 0) for i, n in enumerate(count) if n for q in quantiles for rank in _ranks(n, q)[:2]}
    found: dict[tuple[int, int], int] = {}
    while True:
        found |= {key: lo for key, (lo, hi, _, _) in wanted.items() if lo == hi}
        wanted = {key: r for key, r in wanted.items() if r[0] != r[1]}      # low, high, values below, values in the range
        if not wanted:
            break
        ranges = sorted({(i, lo, hi, n) for (i, _), (lo, hi, _, n) in wanted.items()})      # ranks in one range share it
        seen = dict(zip(ranges, _histogram(d.select(*sorted({f"c{r[0]}" for r in ranges})), ranges)))
        wanted = {key: _narrowed(seen[key[0], lo, hi, n], key[1], below) for key, (lo, hi, below, n) in wanted.items()}
    out = {}
    for i, c in enumerate(columns):
        out[c] = []
        for q in quantiles:
            a, b, w = _ranks(count[i], q) if count[i] else (0, 0, 0.0)
            low, high = (_value(found[i, r]) for r in (a, b)) if count[i] else (None, None)
            out[c].append(low if low == high else low + (high - low) * w)
    return out


def _narrowed(cells: list[tuple], rank: int, below: int) -> tuple[int, int, int, int]:
    """The bucket that holds a rank: its least and greatest value, the values below it and in it."""
    for n, low, high, values in cells:
        if below + n > rank:
            if values is not None:
                low = high = values[rank - below]
            return low, high, below, n
        below += n
    raise ValueError("the rows changed between two passes")


def _histogram(d: DataFrame, ranges: list[tuple]) -> list[list[tuple]]:
    """Per range (column, low, high, values in it) its buckets in order: (values,
    least, greatest, all of them sorted where the range has few)."""
    names = d.columns
    plan = []
    for i, lo, hi, n in ranges:
        whole = (lo, hi) == WHOLE
        plan.append((names.index(f"c{i}"), lo, hi, 0 if whole else lo, POWERS if whole else max((hi - lo).bit_length() - BITS, 0), 0 <= n <= FEW))
    rows = (d.mapInArrow(_counted(plan), "k int, b long, n long, lo long, hi long, values array<long>").groupBy("k", "b")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.flatten(F.collect_list("values")).alias("values")).collect())
    out: list[list[tuple]] = [[] for _ in ranges]
    for r in sorted(rows, key=lambda r: (r.k, r.b)):
        out[r.k].append((r.n, r.lo, r.hi, sorted(r["values"]) or None))
    return out


def _counted(plan: list[tuple]):
    """A task's histograms of its rows: per range the column, low, high, the base and
    the shift of its buckets, and whether its values are few (one bucket, with them)."""
    schema, gathered = CELLS, GATHERED

    def added(cells: list[np.ndarray]) -> list[np.ndarray]:
        """Cells (bucket, values, least, greatest) with equal buckets added up."""
        all_ = np.concatenate(cells, axis=1)
        all_ = all_[:, np.argsort(all_[0], kind="stable")]
        at = np.flatnonzero(np.r_[True, all_[0, 1:] != all_[0, :-1]])
        return [np.stack([all_[0, at], np.add.reduceat(all_[1], at), np.minimum.reduceat(all_[2], at), np.maximum.reduceat(all_[3], at)])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[list[np.ndarray]] = [[] for _ in plan]
        size, few = [0] * len(plan), [[] for _ in plan]
        for batch in batches:
            keys = {}
            for k, (i, lo, hi, base, shift, values) in enumerate(plan):
                if i not in keys:
                    v = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)      # nulls become NaN
                    keys[i] = np.sort(_keys(v[v == v]))
                here = keys[i][np.searchsorted(keys[i], lo):np.searchsorted(keys[i], hi, "right")]
                if not len(here):
                    continue
                if values:
                    few[k].append(here)
                    continue
                b = (here - base) >> shift
                at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                end = np.r_[at[1:], len(b)]
                cells[k].append(np.stack([b[at], end - at, here[at], here[end - 1]]))
                size[k] += len(at)
                if size[k] > gathered:
                    cells[k] = added(cells[k])
                    size[k] = 0
        for k in range(len(plan)):
            if few[k]:
                v = np.concatenate(few[k])
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((k, 0, len(v), int(v.min()), int(v.max()), v.tolist()), schema)], schema=schema)
            elif cells[k]:
                b, n, lo, hi = added(cells[k])[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), k, np.int32)), pa.array(b), pa.array(n), pa.array(lo), pa.array(hi),
                                                  pa.nulls(len(b), schema.field("values").type)], schema=schema)
    return run
