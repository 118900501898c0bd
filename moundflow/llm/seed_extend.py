"""Substring dedup by seed and extend: documents meet on winnowed anchors, the
matches are extended both ways word by word, and maximal repeats of at least
the threshold's length cover the words that go."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundflow.llm.base import Words, free, named, record
from moundflow.llm.repeats import MAX_GROUP, Spec, keyed, merged, run_rows, texts_with_runs, unpacked

LENGTH, GRAM = 35, 6


def match_by_extension(spec: Spec, rows: pa.Table, first: bool):
    """Rows sorted by gram and place, a seed each (word o of the piece).  Every
    row meets the one ``lag`` rows before it in its group, for all groups at
    once; from the seed the match runs left and right while words agree."""
    content = rows["content"].combine_chunks() if isinstance(rows["content"], pa.ChunkedArray) else rows["content"]
    key, o = np.asarray(rows["key"]), np.asarray(rows["o"]).astype(np.int64)
    m = len(key)
    raw = content.to_pylist()
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    w = Words(data, off)
    size = w.counts()
    left, right = int(o.max()), int((size - o).max())
    # words by distance from the seed; what lies outside a piece matches nothing
    table = np.empty((m, left + right), np.uint64)
    table[:] = (np.arange(m, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
    column = np.arange(len(w)) - np.repeat(w.off[:-1], size) + np.repeat(left - o, size)
    table[w.owner(), column] = w.h | np.uint64(1 << 63)
    cover = np.zeros((m, left + right + 1), np.int32)
    begin = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.arange(m) - np.maximum.accumulate(np.where(begin, np.arange(m), 0))
    lag, later = 1, np.flatnonzero(rank >= 1)
    while len(later):
        earlier = later - lag
        same = table[later] == table[earlier]
        # from the seed outwards to the first difference
        r = np.where(same[:, left:].all(axis=1), right, np.argmin(same[:, left:], axis=1))
        back = same[:, :left][:, ::-1]
        l = np.where(back.all(axis=1), left, np.argmin(back, axis=1)) if left else np.zeros(len(later), np.int64)
        long = l + r >= spec.length
        for who in ((later,) if first else (later, earlier)):
            np.add.at(cover, (who[long], left - l[long]), 1)
            np.add.at(cover, (who[long], left + r[long]), -1)
        lag += 1
        later = later[rank[later] >= lag]
    on = np.cumsum(cover, axis=1)[:, :-1] > 0
    edge = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    piece, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    shift = o[piece] - left
    return piece, a + shift, b + shift


def spec_of(length: int = LENGTH, gram: int = GRAM) -> Spec:
    return Spec("words", length, min(gram, length), match_by_extension)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _digest(batches):
    for part, data, off in unpacked(batches):
        w = Words(data, off, hashes=False)
        n, removed, sha = w.counts(), [], []
        raw = data.tobytes()
        s, e = w.s.tolist(), w.e.tolist()
        for d, runs in enumerate(run_rows(part)):
            lo, hi = int(w.off[d]), int(w.off[d + 1])
            gone = merged(runs, hi - lo).tolist() if runs is not None else []
            kept, last = [], lo
            for a, b in gone:
                kept += [raw[s[i]:e[i]] for i in range(last, lo + a)]
                last = lo + b
            kept += [raw[s[i]:e[i]] for i in range(last, hi)]
            removed.append(sum(b - a for a, b in gone))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield record(DIGEST, part.column(part.schema.get_field_index("doc_id")), n, removed, sha)


def repeated_words(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, max_group: int = MAX_GROUP,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, where each word
    goes that a window of ``length`` words covers whose words also start
    elsewhere (``keep_first``: earlier).

    Null and empty texts have no words; texts of fewer than ``length`` words
    lose none; equal rows are copies of each other (with ``keep_first``: one
    document); windows never cross texts."""
    d = keyed(docs, id_col, text_col, named(id_col).cast("long").alias("doc_id"))
    return (texts_with_runs(d, spec_of(length, gram), keep_first, max_group).select("doc_id", "z", "runs")
            .mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, max_group: int = MAX_GROUP,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, same columns, without repeated passages; the first copy
    stays (or with ``keep_first=False`` none).  What stands between two kept
    words stays as it is; a removed passage takes the white space before it."""
    names = docs.columns
    # null and empty texts have nothing to lose and go round
    rest = [c for c in names if c != text_col]
    some = F.length(named(text_col).cast("string")) > 0
    d = keyed(docs.where(some), id_col, text_col, F.struct(F.lit(0).alias(free(docs, "__")), *map(named, rest)).alias("row"))
    found = texts_with_runs(d, spec_of(length, gram), keep_first, max_group).select("row", "z", "runs")

    def run(batches):
        for part, data, off in unpacked(batches):
            w = Words(data, off, hashes=False)
            texts = [data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])]
            for i, runs in enumerate(run_rows(part)):
                if runs is not None:
                    lo, hi = int(w.off[i]), int(w.off[i + 1])
                    raw, kept, last = data[off[i]:off[i + 1]].tobytes(), [], 0
                    for a, b in merged(runs, hi - lo).tolist():
                        kept.append(raw[last:(int(w.e[lo + a - 1]) if a else int(w.s[lo])) - int(off[i])])
                        last = int(w.e[lo + b - 1] - off[i])
                    texts[i] = b"".join([*kept, raw[last:]]).decode()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    out = found.mapInArrow(run, found.select("row", F.lit("").alias("text")).schema)
    out = out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names])
    return out.unionByName(docs.where(~F.coalesce(some, F.lit(False))).withColumn(text_col, named(text_col).cast("string")))
