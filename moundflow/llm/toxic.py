"""Toxic texts: a generative ratio of word starts in labelled toxic and other
text.  Only strong entries count, so good text cannot outweigh them."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundflow.llm.base import ALNUM_LOWER, BYTE_VALUE, LOWER, Rolling, id_text, mix, record, saved, shared, spans, text_slices
from moundflow.llm.quality_rules import labelled_sample

#: Labelled rows of each class: at most so many, the first by hash.
MAX_TOXIC_ROWS, MAX_OTHER_ROWS = 2_000, 10_000
#: An entry stands in so many toxic texts, and its log ratio is at least this.
MIN_TEXTS, STRONG = 3, 2.5
#: Bytes of a word's start that make an entry, besides the whole word.
STARTS = range(4, 9)
#: Labelled rows are scored by tables made without their fold.
FOLDS = 4
#: The cut loses at most this share of the labelled target rows.
LOSS = 0.005
#: Scores are by the root of the text's words and this many more.
MORE_WORDS = 30
_ROLL = Rolling(0xD1342543DE82EF95)


def entries(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and word starts, their text's index, and
    the number of words by text."""
    low = LOWER[data]
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[accented] += 0x20
    s, e, first = spans(ALNUM_LOWER[low], off)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
    p = _ROLL.prefix(BYTE_VALUE[low])
    hashes, owners = [mix(_ROLL.runs(p, s, e) + np.uint64(1))], [owner]
    for k in STARTS:
        at = np.flatnonzero(e - s >= k)
        hashes.append(_ROLL.runs(p, s[at], s[at] + k))
        owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners), np.diff(first)


class Table:
    """Sorted hashes, the log ratio of each by fold (0: not strong), the last
    column without a fold left out; a text is toxic above ``cut``."""

    def __init__(self, hashes: np.ndarray, ratio: np.ndarray, cut: float = float("inf")):
        self.hashes, self.ratio, self.cut = hashes, ratio, cut
        self.seen = np.zeros(1 << 20, bool)
        self.seen[hashes >> np.uint64(44)] = True

    def found(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of the table in each text, each once: text, index; words by text."""
        h, owner, words = entries(data, off)
        some = np.flatnonzero(self.seen[h >> np.uint64(44)])
        h, owner = h[some], owner[some]
        n = len(self.hashes)
        if not n:
            return owner[:0], owner[:0], words
        at = np.minimum(np.searchsorted(self.hashes, h), n - 1)
        both = np.unique((owner * n + at)[self.hashes[at] == h])
        return both // n, both % n, words

    def score(self, data: np.ndarray, off: np.ndarray, fold=FOLDS) -> np.ndarray:
        """Sum of the log ratios; ``fold`` is one for all or one by text."""
        owner, at, words = self.found(data, off)
        fold = np.broadcast_to(fold, len(words))
        return np.bincount(owner, self.ratio[at, fold[owner]], minlength=len(words)) / np.sqrt(words + MORE_WORDS)


def between(good: np.ndarray, bad: np.ndarray, loss: float) -> float:
    """The cut that is reached by all but at most the share ``loss`` of ``good``
    and by the fewest of ``bad``; of equal cuts the middle."""
    if not len(good):
        return float("-inf")
    high = float(np.sort(good)[int(loss * len(good))])
    below = bad[bad < high]
    return (high + float(below.max())) / 2 if len(below) else high


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fold, y (0 toxic, 1 target, 2 other) and text of a bounded sample."""
    per = labels.groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"), F.min("quality").alias("quality"))
    kind = per.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(2).alias("kind"))
    ids = labelled_sample(kind.where("kind = 0"), "kind", limit=MAX_TOXIC_ROWS).unionByName(
        labelled_sample(kind.where("kind > 0"), "kind", limit=MAX_OTHER_ROWS))
    d = id_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
    return saved(d.select(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.col("y").cast("int").alias("y"), "text"))


FOUND = pa.schema([("hash", pa.int64()), *[(f"f{i}", pa.int64()) for i in range(FOLDS)]])
SCORED = pa.schema([("y", pa.int32()), ("score", pa.float64())])


def _text_entries(seen: np.ndarray | None = None):
    """Entries of each text once, counted by fold; with ``seen`` only those whose
    first 20 bits are set in it."""
    def run(batches):
        for part, data, off in text_slices(batches):
            h, owner, _ = entries(data, off)
            if seen is not None:
                some = seen[h >> np.uint64(44)]
                h, owner = h[some], owner[some]
            fold = np.asarray(part.column(0))
            once = np.lexsort((owner, h))
            h, owner = h[once], owner[once]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, inverse = np.unique(h[new], return_inverse=True)
            counts = [np.bincount(inverse, fold[owner[new]] == i, minlength=len(h)).astype(np.int64) for i in range(FOLDS)]
            yield record(FOUND, h.view(np.int64), *counts)
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Table:
    """Log ratios of the share of toxic and of other labelled texts that hold
    an entry, and the cut set on rows that were left out of the table.  All
    entries of the labelled texts are counted in tasks; the driver gets the strong
    ones, however rare, and a score for each sampled row.  Without toxic or
    target rows no text is toxic."""
    rows = labelled(docs, labels, id_col, text_col)
    size = np.zeros((3, FOLDS))
    for y, fold, n in rows.groupBy("y", "fold").count().collect():
        size[y, fold] = n
    if not size[0].sum() or not size[1].sum():
        return Table(np.zeros(0, np.uint64), np.zeros((0, FOLDS + 1)))
    every = "+".join(f"f{i}" for i in range(FOLDS))
    columns = ", ".join(f"f{i} long" for i in range(FOLDS))
    toxic = saved(rows.where("y = 0").mapInArrow(_text_entries(), f"hash long, {columns}").groupBy("hash")
                  .agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(FOLDS)]).where(f"{every} >= {MIN_TEXTS}"))
    seen = np.zeros(1 << 20, bool)
    seen[[r[0] for r in toxic.select(F.shiftrightunsigned("hash", 44)).distinct().collect()]] = True        # 2**20 values at most
    other = (rows.where("y > 0").mapInArrow(_text_entries(seen), f"hash long, {columns}").groupBy("hash")
             .agg(*[F.sum(f"f{i}").alias(f"g{i}") for i in range(FOLDS)]))
    both = toxic.join(other, "hash", "left").fillna(0)
    ratios, strong = [], F.lit(False)
    for fold in range(FOLDS + 1):
        used = [i for i in range(FOLDS) if i != fold]
        a, b = sum(F.col(f"f{i}") for i in used), sum(F.col(f"g{i}") for i in used)
        na, nb = float(size[0, used].sum()), float(size[1:, used].sum())
        r = F.log(F.greatest(a.cast("double"), F.lit(0.5)) / max(1.0, na)) - F.log((b + 0.5) / (nb + 1))
        counts = (a >= MIN_TEXTS) & (r >= STRONG)
        strong = strong | counts
        ratios.append(F.when(counts, r).otherwise(0.0).alias(f"r{fold}"))
    top = both.where(strong).select("hash", *ratios).toArrow()
    hashes = np.asarray(top["hash"]).view(np.uint64)
    order = np.argsort(hashes)
    table = Table(hashes[order], np.stack([np.asarray(top[f"r{i}"]) for i in range(FOLDS + 1)], 1)[order])
    get_all = shared(rows, table)

    def run(batches):
        for part, data, off in text_slices(batches):
            yield record(SCORED, part.column(1), get_all().score(data, off, np.asarray(part.column(0))))

    held = rows.where("y < 2").mapInArrow(run, "y int, score double").toArrow()
    y, score = np.asarray(held["y"]), np.asarray(held["score"])
    table.cut = -between(-score[y == 1], -score[y == 0], LOSS)
    return table
