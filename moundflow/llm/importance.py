"""Quality classifier by importance resampling: hashed n-gram models of target
and raw text, the log ratio of the two as a document's weight, Gumbel top-k."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundflow.llm import toxic as tox
from moundflow.llm.base import BYTE_VALUE, NOT_SPACE, Rolling, byte_class, free, id_text, mix, named, numbered, record, saved, shared, spans, text_slices
from moundflow.llm.quality_rules import labelled_sample

#: Hash buckets of words and word pairs: the models' size does not follow the input.
BUCKETS = 1 << 14
#: Labelled rows that say what target text is: at most so many, the first by hash.
MAX_TARGET_ROWS = 20_000
#: Pseudo-counts, spread like the raw text, that the target counts start with,
#: as a share of these: an unseen word costs the same with few labels and many.
SMOOTH = 0.3
#: Labelled rows are weighed by ratios made without their fold, so the threshold
#: is one for texts the model has not seen.
FOLDS = 4
#: The lowest key that is kept loses at most this share of the labelled target
#: rows; without rejected rows it is ``SLACK`` below what they reach.
LOSS, SLACK = 0.003, 2.0
#: Tried as the gap a gram between seen and unseen target text: by minus these
#: quantiles of the mean ratio of target rows.
GAPS = (0.002, 0.005, 0.01, 0.02, 0.05)
_ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_ROLL = Rolling(0x8EBC6AF09C88C6E3)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of tokens (runs of letters and digits, runs of other
    marks) and of token pairs, text by text, with their text's index.  Pairs of
    a token that is said again and again share a bucket."""
    kind = _ALNUM[data]
    split = np.zeros(len(data), bool)
    split[1:] = kind[1:] != kind[:-1]
    s, e, first = spans(NOT_SPACE[data], off, split)
    h = _ROLL.runs(_ROLL.prefix(BYTE_VALUE[data]), s, e)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = mix(h[pair] * np.uint64(3) + h[pair + 1])
    again, n = h[pair] == h[pair + 1], len(h) - 4
    if n > 0:       # with a mark between: x . x . x
        every = (h[:n] == h[2:n + 2]) & (h[:n] == h[4:]) & (owner[:n] == owner[4:])
        again |= np.append(every, np.zeros(4, bool))[pair]
    pairs[again] = 0
    b = np.concatenate([mix(h), pairs]) % np.uint64(BUCKETS)
    return b.astype(np.int64), np.concatenate([owner, owner[pair]])


COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), *[(f"t{i}", pa.int64()) for i in range(FOLDS)]])


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros((FOLDS, BUCKETS), np.int64)
    for part, data, off in text_slices(batches):
        b, owner = grams(data, off)
        raw += np.bincount(b, minlength=BUCKETS)
        fold = np.asarray(part.column(1).fill_null(-1))[owner]
        for i in range(FOLDS):
            target[i] += np.bincount(b[fold == i], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield record(COUNTS, some.astype(np.int32), raw[some], *target[:, some])


def judged_rows(labels: DataFrame, limit: int = MAX_TARGET_ROWS) -> DataFrame:
    """Labelled ids with y = 1 for target text, good quality and not toxic, and
    y = 0 for rejected text, bad quality."""
    kind = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), 1)
    return labelled_sample(labels.select("doc_id", kind.alias("kind")), "kind", limit=limit)


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("held"), doc_id), F.lit(FOLDS)).cast("int")


def counts(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts by hash bucket: raw, of every document, and by fold those of the
    ids that have y = 1 in ``target`` (a bounded table, so it is broadcast); a
    task sends at most BUCKETS rows, the driver gets BUCKETS sums."""
    t = target.where("y = 1").select("doc_id").distinct().withColumn("fold", _fold(F.col("doc_id")))
    d = id_text(docs, id_col, text_col).join(F.broadcast(t), "doc_id", "left").select("doc_id", "fold", "text")
    names = [n for n in COUNTS.names if n != "bucket"]
    sums = d.mapInArrow(_count, "bucket int, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*[F.sum(n) for n in names]).collect()
    out = np.zeros((1 + FOLDS, BUCKETS))
    for b, *got in sums:
        out[:, b] = got
    return out[0], out[1:]


def log_ratio(raw: np.ndarray, target: np.ndarray, smooth: float | None = None) -> np.ndarray:
    """log(p_target / p_raw) by hash bucket; ``smooth`` pseudo-counts, SMOOTH
    of the target counts by default."""
    if not target.sum():
        return np.zeros(BUCKETS)
    smooth = SMOOTH * target.sum() if smooth is None else smooth
    p = (raw + 0.01) / (raw + 0.01).sum()
    return np.log((target + smooth * p) / (target.sum() + smooth) / p)


def fit(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", smooth: float | None = None) -> np.ndarray:
    """log(p_target / p_raw) by hash bucket."""
    raw, tgt = counts(docs, target, id_col, text_col)
    return log_ratio(raw, tgt.sum(0), smooth)


def gumbel(doc_id: Column, text: Column, seed: int) -> Column:
    """Standard Gumbel noise that a row always gets again."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
          least: float | None = None, toxic: tox.Table | None = None) -> DataFrame:
    """The documents with __weight (log p_target - log p_raw of the text),
    __key (weight plus Gumbel noise) and, given a ``toxic`` table, __toxic (more
    underscores where a name is taken); or with ``least`` only those whose key
    reaches it and that are not toxic, columns as they were; same partitions, no
    shuffle.  Null and empty texts weigh 0."""
    names, t = docs.columns, named(text_col).cast("string")
    d = docs.select(*map(named, names), gumbel(named(id_col), t, seed).alias("noise"), t.alias("words"))
    d, k = numbered(d), len(names)
    table = docs.sparkSession.sparkContext.broadcast(ratio)
    judge = shared(docs, toxic) if toxic is not None else None
    added = [] if least is not None else [F.lit(0.0).alias("weight"), F.lit(0.0).alias("key")] + [F.lit(False).alias("toxic")] * (judge is not None)

    def run(batches):
        for part, data, off in text_slices(batches, f"c{k + 1}"):
            b, owner = grams(data, off)
            weight = np.bincount(owner, table.value[b], minlength=len(off) - 1)
            key = weight + np.asarray(part.column(k))
            own = pa.RecordBatch.from_arrays(part.columns[:k], names=part.schema.names[:k])
            bad = judge().score(data, off) > judge().cut if judge else np.zeros(len(key), bool)
            if least is None:
                more = {"weight": pa.array(weight), "key": pa.array(key)} | ({"toxic": pa.array(bad)} if judge else {})
                yield pa.RecordBatch.from_arrays([*own.columns, *more.values()], names=[*own.schema.names, *more])
            else:
                yield own.filter(pa.array((key >= least) & ~bad))

    out = d.mapInArrow(run, d.select(*[f"c{i}" for i in range(k)], *added).schema)
    return out.toDF(*names, *[free(docs, x) for x in ("__weight", "__key", "__toxic")[:len(added)]])


HELD = pa.schema([("y", pa.float64()), ("noise", pa.float64()), ("weight", pa.float64()), ("n", pa.int64())])


def held_out(docs: DataFrame, ratios: np.ndarray, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> pa.Table:
    """y, noise, weight and number of grams of the labelled rows, weighed by
    the ratios (by fold, bucket) that were made without them."""
    d = id_text(docs, id_col, text_col).join(F.broadcast(judged), "doc_id")
    d = d.select("y", gumbel(F.col("doc_id"), F.col("text"), seed).alias("noise"), _fold(F.col("doc_id")).alias("fold"), "text")
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for part, data, off in text_slices(batches):
            b, owner = grams(data, off)
            fold, n = np.asarray(part.column(2)), len(off) - 1
            noise = part.column(1).fill_null(0.0)
            yield record(HELD, part.column(0), noise, np.bincount(owner, table.value[fold[owner], b], minlength=n), np.bincount(owner, minlength=n))

    return d.mapInArrow(run, "y double, noise double, weight double, n long").toArrow()


def threshold(held: pa.Table, loss: float = LOSS) -> tuple[float, float]:
    """(gap, lowest key that is kept): the k of the top-k as the key the last
    of the k has.  Unseen target text weighs less than the text that was
    counted, a gap a gram, added to the ratios; of the gaps tried the one by
    which a cut that loses at most ``loss`` of the target rows keeps the fewest
    rejected rows, the cut in the middle between both."""
    y, key, n = np.asarray(held["y"]), np.asarray(held["weight"]) + np.asarray(held["noise"]), np.asarray(held["n"])
    good, bad = y == 1, y == 0
    if not good.any():
        return 0.0, float("-inf")
    if not bad.any():
        return 0.0, min(0.0, tox.between(key[good], key[bad], loss)) - SLACK
    mean = np.asarray(held["weight"])[good] / np.maximum(n[good], 1)
    best = []
    for gap in (0.0, *(-np.quantile(mean, GAPS))):
        k = key + gap * n
        cut = tox.between(k[good], k[bad], loss)
        best.append(((k[bad] >= cut).sum(), (k[good] < cut).sum(), abs(gap), gap, cut))
    return tuple(map(float, min(best)[3:]))


def fit_all(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TARGET_ROWS) -> tuple[np.ndarray, float]:
    """(log ratios, lowest key that is kept) from the documents and labels."""
    judged = saved(judged_rows(labels, max_rows))
    raw, target = counts(docs, judged)
    gap, least = threshold(held_out(docs, np.stack([log_ratio(raw, target.sum(0) - target[i]) for i in range(FOLDS)]), judged))
    return log_ratio(raw, target.sum(0)) + gap, least


def sample_size(weighed: DataFrame, least: float, weight: str = "__weight", toxic: str = "__toxic") -> int:
    """The k of the top-k: how many texts that are not toxic weigh as much as the
    labelled target rows ask for."""
    return weighed.where((named(weight) >= least) & ~named(toxic)).count()


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The k documents, not toxic, with the largest keys, same columns and
    partitions; k is the number whose weight reaches the threshold between
    labelled target and rejected rows.  Without any labelled target row nothing is
    rejected.  Null and empty texts weigh 0; equal rows share their noise and so
    their fate, all that tie for the last place stay.  Only keys are written to find
    the last one; the texts are weighed once more, not shuffled."""
    ratio, least = fit_all(docs, labels)
    judge = tox.fit(docs, labels)
    keys = saved(weigh(id_text(docs), ratio, toxic=judge).select("__weight", "__key", "__toxic"))
    k, rows = sample_size(keys, least), keys.where(~F.col("__toxic"))
    if k <= 0:
        return docs.limit(0)
    last = float("-inf") if k >= rows.count() else kth_key(rows, k)[0]
    return weigh(docs, ratio, least=last, toxic=judge)


def kth_key(rows: DataFrame, k: int, key: str = "__key", bins: int = 4096) -> tuple[float, int]:
    """The k-th largest key of rows that have more than k, and how many of the
    rows that tie for it are among the k.  It is found by counting rows in bins of
    the key's range, finer each round, so neither a task nor the driver sees more
    than the bins."""
    x = named(key)
    lo, hi = rows.agg(F.min(x), F.max(x)).first()
    need, inside = k, rows
    while lo < hi:
        b = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
        for _, c, low, high in sorted(inside.groupBy(b.alias("b")).agg(F.count(x), F.min(x), F.max(x)).collect(), reverse=True):
            if c >= need:
                lo, hi = low, high
                break
            need -= c
        inside = rows.where(x.between(lo, hi))
    return lo, need


def _parts(weighed: DataFrame, k: int, key: str, bins: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows above the k-th key, those that tie for it and are taken, all that tie."""
    x = named(key)
    rows = weighed.where(x.isNotNull())
    if k >= rows.count():
        return rows, rows.limit(0), rows.limit(0)
    if k <= 0:
        return rows.limit(0), rows.limit(0), rows.limit(0)
    lo, need = kth_key(rows, k, key, bins)
    ties = rows.where(x == lo)
    by = [named(c) for c in weighed.columns]
    return rows.where(x > lo), ties.orderBy(F.xxhash64(*by), *by[:1]).limit(need), ties


def gumbel_top_k(weighed: DataFrame, k: int, bins: int = 4096, key: str = "__key") -> DataFrame:
    """The k rows with the largest key (all rows if there are fewer; null keys
    never).  Rows that tie for the last places are taken by hash of their
    columns.  ``weighed`` is read once a round: save it first."""
    above, taken, _ = _parts(weighed, k, key, bins)
    return above.unionByName(taken)


def mark_top_k(weighed: DataFrame, k: int, out: str, bins: int = 4096, key: str = "__key") -> DataFrame:
    """All rows, with a column that says whether ``gumbel_top_k`` takes them."""
    x = named(key)
    if k >= weighed.where(x.isNotNull()).count() or k <= 0:
        return weighed.withColumn(out, x.isNotNull() & F.lit(k > 0))
    lo, need = kth_key(weighed.where(x.isNotNull()), k, key, bins)
    _, taken, ties = _parts(weighed, k, key, bins)
    if ties.count() == need:
        return weighed.withColumn(out, F.coalesce(x >= lo, F.lit(False)))
    rest = weighed.where(F.coalesce(x != lo, F.lit(True))).withColumn(out, F.coalesce(x > lo, F.lit(False)))
    return (rest.unionByName(taken.withColumn(out, F.lit(True))).unionByName(ties.exceptAll(taken).withColumn(out, F.lit(False))))
