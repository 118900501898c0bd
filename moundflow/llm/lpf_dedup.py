"""Suffix-array dedup by longest previous factors: the suffixes of pieces that may
repeat are put in order, the previous and next smaller positions of an entry in
that order hold its longest earlier match, and where that has 200 bytes or more
the bytes it covers go.  Lengths are cut at 200."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundflow.llm.base import free, named, record
from moundflow.llm.repeats import MAX_GROUP, Spec, keyed, merged, run_rows, texts_with_runs, unpacked

LENGTH, GRAM = 200, 32


# --- suffix array, longest previous factors ----------------------------------

def suffix_levels(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, ranks) for lengths 8, 16, ... up to ``depth``: the rank of every
    suffix by that many bytes, the number of suffixes that are smaller; suffixes
    that agree on them share a rank.  The first 8 bytes (or ``depth``) are sorted as
    a number, then prefixes double; a suffix whose rank is its own is not sorted
    again.  What stands after the end counts as zero bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    have = min(8, depth)
    key = np.zeros(n, np.uint64)
    for j in range(have):
        key = (key << np.uint64(8)) | padded[j:n + j]
    rank = np.zeros(n + depth, np.int64)
    todo = np.arange(n)
    head = np.zeros(n, np.int64)        # rank of the group that each of todo is in
    levels = []
    while True:
        order = np.argsort(key)
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        # todo's groups come in rank order, so a rank is its group's plus the place in it
        group = head[order]
        start = np.ones(len(k), bool)
        start[1:] = group[1:] != group[:-1]
        begin = np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))
        r = group + first - begin
        rank[todo[order]] = r
        levels.append((have, rank[:n].copy()))
        if have >= depth:
            return levels
        last = np.append(new[1:], True)
        tied = ~(new & last)
        todo = todo[order[tied]]
        head = r[tied]
        if not len(todo):
            return levels
        step = min(have, depth - have)
        beyond = rank[todo + step] + 1
        beyond[todo + step >= n] = 0
        key = head * (n + 1) + beyond
        have += step


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` bytes."""
    return suffix_levels(text, depth)[-1][1]


def common_prefix(text: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Bytes on which the suffixes at a and b agree, ``depth`` at most: equal ranks
    of the longest level first, then of shorter ones, the last bytes one by one."""
    n, have = len(text), np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        x, y = a + have, b + have
        inside = np.maximum(x, y) + size <= n
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]) & (have + size <= depth)
        have += size * same
    going = have < depth
    for _ in range(min(levels[0][0], depth) - 1):
        x, y = a + have, b + have
        going &= (np.maximum(x, y) < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]) & (have < depth)
        have += going
    return have


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value before each, else -1: minima of runs
    of 1, 2, 4, ... values, the longest that are all larger are stepped over."""
    n = len(v)
    minima = [v]
    while (1 << len(minima)) <= n:
        half = 1 << (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
    at = np.arange(n)
    for k in range(len(minima) - 1, -1, -1):
        begin = at - (1 << k)
        over = (begin >= 0) & (minima[k][np.maximum(begin, 0)] > v)
        at = np.where(over, begin, at)
    return at - 1


def longest_previous(text: np.ndarray, levels: list[tuple[int, np.ndarray]], places: np.ndarray, value: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) of the longest previous factor of entries in suffix
    order: the longer of the common prefixes with the nearest entry before and the
    nearest after it, in that order, whose ``value`` is smaller.  With positions as
    values these are the longest previous factors, with negated ones the next."""
    length, source = np.zeros(len(places), np.int64), np.full(len(places), -1)
    back = previous_smaller(value)
    ahead = len(value) - 1 - previous_smaller(value[::-1])[::-1]
    for near, some in ((back, back >= 0), (ahead, ahead < len(value))):
        i = np.flatnonzero(some)
        of = places[near[i]]
        have = common_prefix(text, levels, places[i], of, depth)
        better = have > length[i]
        length[i[better]], source[i[better]] = have[better], of[better]
    return length, source


def previous_and_next(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start: the source of its longest previous and of its longest next
    factor among the starts, where that has ``depth`` bytes, else -1."""
    prev, after = np.full(len(starts), -1), np.full(len(starts), -1)
    if not len(starts):
        return prev, after
    levels = suffix_levels(text, depth)
    order = np.argsort(levels[-1][1][starts], kind="stable")     # starts ascend: ties stay in order of position
    places = starts[order]
    for out, value in ((prev, places), (after, -places)):
        length, source = longest_previous(text, levels, places, value, depth)
        out[order] = np.where(length >= depth, source, -1)
    return prev, after


def match_by_suffixes(spec: Spec, rows: pa.Table, first: bool):
    """Pieces that share grams, laid out in document order; the longest previous
    (and next) factors of their windows say which repeat."""
    content = rows["content"].combine_chunks() if isinstance(rows["content"], pa.ChunkedArray) else rows["content"]
    place = pc.sort_indices(rows, sort_keys=[("r2", "ascending"), ("r1", "ascending"), ("s", "ascending")])
    order = np.asarray(place).astype(np.int64)
    text = np.frombuffer(b"".join(content.take(place).to_pylist()), np.uint8)
    n = np.asarray(rows["n"]).astype(np.int64)[order]
    size = n + spec.length - 1
    begin = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    # windows only: they end inside their piece, so no match crosses its end
    prev, after = previous_and_next(text, begin[piece] + off, spec.length)
    hit = np.flatnonzero((prev >= 0) if first else (prev >= 0) | (after >= 0))
    piece, off = piece[hit], off[hit]
    if not len(hit):
        return piece, off, off
    new = np.ones(len(hit), bool)       # neighbouring windows of a piece make one run
    new[1:] = (piece[1:] != piece[:-1]) | (off[1:] != off[:-1] + 1)
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(hit)) - 1
    return order[piece[i]], off[i], off[last] + spec.length


def spec_of(length: int = LENGTH, gram: int = GRAM) -> Spec:
    return Spec("bytes", length, min(gram, length), match_by_suffixes)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digest(batches):
    for part, data, off in unpacked(batches):
        removed, count, sha = [], [], []
        for d, runs in enumerate(run_rows(part)):
            raw = data[off[d]:off[d + 1]]
            if runs is None:
                removed.append(0)
                count.append(0)
                sha.append(hashlib.sha256(raw.tobytes()).hexdigest())
                continue
            gone, h, last = merged(runs, len(raw)), hashlib.sha256(), 0
            for a, b in gone.tolist():
                h.update(raw[last:a].tobytes())
                last = b
            h.update(raw[last:].tobytes())
            removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
            count.append(len(gone))
            sha.append(h.hexdigest())
        yield record(DIGEST, part.column(part.schema.get_field_index("doc_id")), np.diff(off), removed, count, sha)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, max_group: int = MAX_GROUP,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, where each
    byte goes that a ``length``-byte string covers which also starts elsewhere
    (``keep_first``: earlier).

    Null and empty texts have no bytes; texts shorter than ``length`` lose none;
    equal rows are copies of each other (with ``keep_first``: one document);
    matches never cross texts."""
    d = keyed(docs, id_col, text_col, named(id_col).cast("long").alias("doc_id"))
    return (texts_with_runs(d, spec_of(length, gram), keep_first, max_group).select("doc_id", "z", "runs")
            .mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def remove_later_copies(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, max_group: int = MAX_GROUP,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, same columns, without later copies of ``length``-byte
    strings; the first stays (or with ``keep_first=False`` none).  A cut never
    splits a character: a character goes when all of its bytes go."""
    names = docs.columns
    # null and empty texts have nothing to lose and go round
    rest = [c for c in names if c != text_col]
    some = F.length(named(text_col).cast("string")) > 0
    d = keyed(docs.where(some), id_col, text_col, F.struct(F.lit(0).alias(free(docs, "__")), *map(named, rest)).alias("row"))
    found = texts_with_runs(d, spec_of(length, gram), keep_first, max_group).select("row", "z", "runs")

    def run(batches):
        for part, data, off in unpacked(batches):
            texts = [data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])]
            for i, runs in enumerate(run_rows(part)):
                if runs is not None:
                    raw = data[off[i]:off[i + 1]]
                    keep = np.ones(len(raw), bool)
                    for a, b in merged(runs, len(raw)).tolist():
                        keep[a:b] = False
                    char = np.cumsum((raw & 0xC0) != 0x80) - 1
                    keep = np.bincount(char, keep, minlength=char[-1] + 1)[char] > 0
                    texts[i] = raw[keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    out = found.mapInArrow(run, found.select("row", F.lit("").alias("text")).schema)
    out = out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names])
    return out.unionByName(docs.where(~F.coalesce(some, F.lit(False))).withColumn(text_col, named(text_col).cast("string")))
