"""Quality rules: fixed rules on counts, then a hashed word and character
n-gram logistic regression, calibrated, against a fixed threshold."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundflow.llm.base import (BYTE_VALUE, NOT_SPACE, Rolling, Words, byte_class, code_points, id_text, mix, per_text, record,
                                shared, spans, text_slices)

#: Characters of [#*$%&|<>].
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
LINE_END = byte_class((0x0A, 0x0A))
REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Labelled rows the model is fitted on: at most so many, the first by hash.
MAX_TRAIN_ROWS = 1_200
BITS = 18
#: A text is kept if its calibrated probability of good quality reaches this.
THRESHOLD = 0.3
_ROLL = Rolling(0xA0761D6478BD642F)
_BYTES = Rolling(0xE7037ED1A0B428DB)


# --- counts ------------------------------------------------------------------

def _duplicates(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one in the same text, and which an earlier one."""
    both, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key):
        order = np.lexsort((key, owner))        # stable: equal entries stay in text order
        k, o = key[order], owner[order]
        same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
        both[order[1:][same]] = both[order[:-1][same]] = True
        again[order[1:][same]] = True
    return both, again


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by text."""
    w = Words(data, off)
    owner, cp = w.owner(), code_points(data)
    out = {"n_words": w.counts(), "word_chars": per_text(cp[w.e] - cp[w.s], w.off), "n_symbols": per_text(SYMBOLS[data], off)}
    # lines with a word: runs between line ends, whole, white space included
    s, e, first = spans(~LINE_END[data], off)
    word = np.searchsorted(w.s, s)
    has = (word < len(w.s)) & (np.append(w.s, len(data))[np.minimum(word, len(w.s))] < e)
    s, e = s[has], e[has]
    line_owner = np.repeat(np.arange(len(off) - 1), np.diff(first))[has]
    p = _BYTES.prefix(BYTE_VALUE[data])
    _, again = _duplicates(_BYTES.runs(p, s, e) ^ mix((e - s).astype(np.uint64)), line_owner)
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=len(off) - 1)
    # words in windows that stand at least twice in the text
    n = REPEAT_WINDOW
    covered = np.zeros(len(w) + 1, np.int64)
    if len(w) >= n:
        h = _ROLL.grams(_ROLL.prefix(w.h), n)
        at = np.flatnonzero(owner[:len(h)] == owner[n - 1:])
        both, _ = _duplicates(h[at], owner[at])
        covered[at[both]] += 1
        covered[at[both] + n] -= 1
    out["n_repeat_words"] = per_text(np.cumsum(covered[:-1]) > 0, w.off)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out


# --- hashed n-grams ----------------------------------------------------------

def features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of (hashed feature, text offsets): words, word pairs, byte
    3-grams and 4-grams; none crosses a text."""
    w, out = Words(data, off), []
    mask, owner = np.uint64((1 << BITS) - 1), w.owner()
    out.append((mix(w.h + np.uint64(1)) & mask, w.off))
    if len(w) > 1:
        ok = owner[:-1] == owner[1:]
        n = np.concatenate([[0], np.cumsum(ok)])
        pair = mix(w.h[:-1] * np.uint64(3) + w.h[1:])[ok] & mask
        out.append((pair, n[np.minimum(w.off, len(ok))]))
    p = _BYTES.prefix(BYTE_VALUE[data])
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for k in (3, 4):
        if len(data) >= k:
            ok = text[:len(data) - k + 1] == text[k - 1:]
            n = np.concatenate([[0], np.cumsum(ok)])
            out.append((mix(_BYTES.grams(p, k) + np.uint64(k))[ok] & mask, n[np.minimum(off, len(ok))]))
    return out


class Model:
    """logit = bias + scale * (mean weight of each feature group, summed), then
    calibrated: p = 1 / (1 + exp(-(a * logit + b)))."""

    def __init__(self, weights: np.ndarray, bias: float, a: float = 1.0, b: float = 0.0):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def logit(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        total = np.full(len(off) - 1, self.bias)
        for f, at in features(data, off):
            c = np.zeros(len(f) + 1)
            np.cumsum(self.weights[f], out=c[1:], dtype=np.float64)
            n = np.diff(at)
            total += (c[at[1:]] - c[at[:-1]]) / np.maximum(n, 1)
        return total

    def probability(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.logit(data, off) + self.b, -60, 60)))


SPARSE = pa.schema([("r", pa.int64()), ("y", pa.float64()), ("f", pa.list_(pa.int32())), ("v", pa.list_(pa.float32()))])


def _sparse(batches):
    for part, data, off in text_slices(batches):
        groups = features(data, off)
        rows_f, rows_v = [], []
        for d in range(len(off) - 1):
            fs = [g[at[d]:at[d + 1]].astype(np.int64) for g, at in groups]
            f = np.concatenate(fs) if fs else np.zeros(0, np.int64)
            v = np.concatenate([np.full(len(x), 1 / max(1, len(x))) for x in fs]) if fs else np.zeros(0)
            u, inv = np.unique(f, return_inverse=True)
            rows_f.append(u.astype(np.int32))
            rows_v.append(np.bincount(inv, v, minlength=len(u)).astype(np.float32))
        yield record(SPARSE, part.column(0), part.column(1), rows_f, rows_v)


def _fit(rows, y, keep, steps: int = 60, rate: float = 1.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch AdaGrad on sparse rows (start offsets, features, values)."""
    at, f, v = rows
    row = np.repeat(np.arange(len(y)), np.diff(at))
    w, bias = np.zeros(1 << BITS), 0.0
    g2, b2 = np.full(1 << BITS, 1e-8), 1e-8
    pos = max(1.0, y[keep].sum())
    neg = max(1.0, keep.sum() - y[keep].sum())
    weight = np.where(y > 0, 0.5 / pos, 0.5 / neg) * keep       # both classes weigh the same
    for _ in range(steps):
        z = np.bincount(row, w[f] * v, minlength=len(y)) + bias
        err = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g = np.bincount(f, err[row] * v, minlength=1 << BITS) + l2 * w / (1 << BITS)
        gb = err.sum()
        g2 += g * g
        b2 += gb * gb
        w -= rate * g / np.sqrt(g2)
        bias -= 0.1 * gb / np.sqrt(b2)
    return w, bias


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of p = sigmoid(a z + b) by Newton steps with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    s = z.std() or 1.0
    x, a, b = z / s, 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p) + 1e-9
        hess = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3) / s), float(b)


def labelled_sample(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", limit: int = MAX_TRAIN_ROWS) -> DataFrame:
    """At most ``limit`` labelled ids with their label y (0 or 1), the first by
    hash of the id: the same rows whatever the partitions.  Rows with a null id
    or label are left out; an id with several labels takes the lowest."""
    return (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna()
            .groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on whole texts of a bounded sample of labelled rows (its features
    are what the driver gathers), calibrate on every fifth row, held out of the
    fit that is calibrated, then refit on all.  Without rows of both classes
    every text gets probability 1."""
    sample = labelled_sample(labels, label_col, limit=max_rows)      # at most max_rows rows: small enough to broadcast
    got = (id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
           .select(F.xxhash64("doc_id", "text").alias("r"), "y", "text").dropDuplicates(["r"])
           .mapInArrow(_sparse, "r long, y double, f array<int>, v array<float>").toArrow().sort_by("r"))
    y = np.asarray(got["y"])
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 30.0)
    f, v = got["f"].combine_chunks(), got["v"].combine_chunks()
    rows = (np.asarray(f.offsets).astype(np.int64), np.asarray(f.values), np.asarray(v.values).astype(np.float64))
    every, fold = np.ones(len(y), bool), np.arange(len(y)) % 5 == 0
    a, b = 1.0, 0.0
    if 0 < y[fold].sum() < fold.sum() and 0 < y[~fold].sum() < (~fold).sum():
        w, bias = _fit(rows, y, ~fold)
        z = np.bincount(np.repeat(np.arange(len(y)), np.diff(rows[0])), w[rows[1]] * rows[2], minlength=len(y)) + bias
        a, b = _platt(z[fold], y[fold])
    return Model(*_fit(rows, y, every), a, b)


JUDGED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
                    ("probability", pa.float64()), ("kept", pa.bool_())])


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, base_failed, the calibrated probability and kept for every
    row.  Null and empty texts have no words and fail the base rules; repeated
    rows are judged one by one; nothing is shuffled."""
    d = id_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    get = shared(d, model)

    def run(batches):
        for part, data, off in text_slices(batches):
            c, p = base_counts(data, off), get().probability(data, off)
            yield record(JUDGED, part.column(0), *[c[k] for k in JUDGED.names[1:7]], p, ~c["base_failed"] & (p >= threshold))

    return d.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                             "n_repeat_words long, base_failed boolean, probability double, kept boolean")
