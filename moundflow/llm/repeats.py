"""Repeated runs of units (bytes or words) over a whole corpus, exactly.

Shared by the two substring operators.  A run of ``length`` units is looked for
wherever it starts; the steps are:

1. Anchors.  Of the grams in every window of ``length`` units the one with the
   smallest hash is the window's anchor (winnowing), so equal windows have equal
   anchors at equal offsets.  Neighbouring windows mostly share an anchor; the
   units such windows cover are a *piece*.  Per anchor only two hashes and the
   place are shuffled, about one row per half ``length`` units.
2. Anchors whose gram stands once in the corpus are dropped: none of their
   windows repeats.  If all pieces of a gram are equal, every window in them
   repeats.  The rest is mixed: equal pieces collapse to their first place.
3. The distinct pieces of a mixed gram are compared with each other by the
   operator's method, in groups of at most ``MAX_GROUP``.
4. Pieces of a gram with more distinct ones than that (a passage that very many
   texts share, with as many different surroundings) are cut again by longer
   grams, whose anchors far fewer of them share, and what comes out goes through
   steps 2 and 3.  The last grams are whole windows, which need no comparison, so
   no task holds such a group and few pieces are ever taken window by window.

No step drops rows or caps partners, and no pairs are shuffled."""
from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundflow.llm.base import BATCH_BYTES, BYTE_VALUE, Rolling, Words, mix, named, record, saved, text_slices

U64 = np.uint64
#: Distinct pieces of one gram that are compared in one task.
MAX_GROUP = 256
#: Bytes of pieces that are compared at once (complete groups).
CHUNK_BYTES = 1 << 18
LOW = U64(0xFFFFFFFF)
_RUN = Rolling(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Spec:
    """What a unit is (``bytes`` or ``words``), units of a window and of an
    anchor gram, and how pieces of equal grams are compared."""
    unit: str
    length: int
    gram: int
    match: Callable

    def units(self, data: np.ndarray, off: np.ndarray):
        """(value of each unit, unit offsets of the texts, Words or None)"""
        if self.unit == "bytes":
            return BYTE_VALUE[data], off, None
        w = Words(data, off)
        return w.h, w.off, w


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def pieces(values: np.ndarray, off: np.ndarray, gram: int, length: int):
    """Per piece: index of its text, first window (unit index in the slice), its
    number of windows, offset of the anchor in it, gram hash, piece hash."""
    none = np.zeros(0, np.int64)
    n = np.maximum(np.diff(off) - length + 1, 0)
    if not n.any():
        return none, none, none, none, none.astype(U64), none.astype(U64)
    prefix = _RUN.prefix(values)
    low = _RUN.raw_grams(prefix, gram)
    # the high half of a gram's hash and its place in one number: the minimum is
    # the smallest hash, the first of equals
    low &= ~LOW
    low |= np.arange(len(low), dtype=U64)
    low = sliding_min(low, length - gram + 1)
    # a piece ends where the anchor changes or its text has no more windows
    some = np.flatnonzero(n)
    cut = np.unique(np.concatenate([np.flatnonzero(low[1:] != low[:-1]) + 1, off[some], off[some] + n[some]]))
    text = np.searchsorted(off, cut, "right") - 1
    ok = np.flatnonzero(cut[:-1] < off[text[:-1]] + n[np.minimum(text[:-1], len(n) - 1)])
    s, count, text = cut[ok], cut[ok + 1] - cut[ok], text[ok]
    at = (low[s] & LOW).astype(np.int64)
    run = _RUN.runs(prefix, s, s + count + length - 1)
    key = _RUN.runs(prefix, at, at + gram)
    return text, s, count, at - s, key, mix(run + (at - s).astype(U64) * U64(0x9E3779B97F4A7C15) + count.astype(U64))


#: A piece's place in one number: first unit, windows, anchor offset (both
#: below PLACE, so windows have fewer units than that).
PLACE = 1 << 12
OCC = pa.schema([("key", pa.int64()), ("ph", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("p", pa.int64())])
OCC_SQL = "key long, ph long, r1 long, r2 long, p long"


def _segments(batches: Iterator[pa.RecordBatch], spec: Spec):
    """Slices of texts; a text of bytes over twice BATCH_BYTES comes in segments
    that share ``length`` - 1 bytes, with the position each begins at, so that
    memory does not follow a text's size (pieces are cut there, which only makes
    them smaller)."""
    for part, data, off in text_slices(batches):
        if spec.unit == "bytes" and len(off) == 2 and off[1] > 2 * BATCH_BYTES:
            for a in range(0, int(off[1]) - spec.length + 1, BATCH_BYTES):
                b = min(int(off[1]), a + BATCH_BYTES + spec.length - 1)
                yield part, data[a:b], np.array([0, b - a]), a
        else:
            yield part, data, off, 0


def _occurrences(spec: Spec):
    def run(batches):
        for part, data, off, base in _segments(batches, spec):
            values, at, _ = spec.units(data, off)
            text, s, n, o, key, ph = pieces(values, at, spec.gram, spec.length)
            r1, r2 = np.asarray(part.column(0))[text], np.asarray(part.column(1))[text]
            yield record(OCC, key.view(np.int64), ph.view(np.int64), r1, r2, ((s - at[text] + base) * PLACE + n) * PLACE + o)
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames: what a shuffle of texts moves is a third less."""
    import zstandard
    z = zstandard.ZstdCompressor(level=1, write_checksum=False)
    for part, data, off in text_slices(batches):
        raw = data.tobytes()
        packed = pa.array([z.compress(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed], names=[*part.schema.names[:-1], "z"])


def packed(docs: DataFrame) -> DataFrame:
    """docs (its last column is text) with the text packed as z."""
    schema = docs.drop("text").withColumn("z", F.lit(None).cast("binary")).schema
    return docs.mapInArrow(_pack, schema)


def unpacked(batches: Iterator[pa.RecordBatch], column: str = "z") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice, UTF-8 bytes, offsets) of batches with packed texts, a limited
    number of bytes at a time."""
    import zstandard
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        col, held, size, first = batch.column(batch.schema.get_field_index(column)), [], 0, 0
        for i, x in enumerate(col):
            held.append(z.decompress(x.as_py()))
            size += len(held[-1])
            if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                yield (batch.slice(first, len(held)), np.frombuffer(b"".join(held), np.uint8),
                       np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64))
                held, size, first = [], 0, i + 1


CUT = pa.schema([("key", pa.int64()), ("hot", pa.bool_()), ("r1", pa.int64()), ("r2", pa.int64()), ("s", pa.int64()), ("n", pa.int32()),
                 ("o", pa.int32()), ("content", pa.binary())])
CUT_SQL = "key long, hot boolean, r1 long, r2 long, s long, n int, o int, content binary"


def _contents(spec: Spec, data: np.ndarray, words: Words | None, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """The bytes of pieces, from unit ``first`` of the slice, of ``n`` windows."""
    last = first + n + spec.length - 1
    a, b = (first, last) if words is None else (words.s[first], words.e[last - 1])
    raw = data.tobytes()
    return pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())


def _cut(spec: Spec):
    """Texts with the pieces wanted from them (struct key, p, hot): a row with
    its content for each."""
    def run(batches):
        for part, data, off in unpacked(batches):
            want = part.column(part.schema.get_field_index("want"))
            lens = np.asarray(want.value_lengths().fill_null(0))
            w = want.flatten()
            key, p, hot = (np.asarray(w.field(i)) for i in range(3))
            s, n, o = p // (PLACE * PLACE), p // PLACE % PLACE, p % PLACE
            text = np.repeat(np.arange(len(lens)), lens)
            words = None if spec.unit == "bytes" else Words(data, off)
            first = (off if words is None else words.off)[text] + s
            yield record(CUT, key, hot, np.asarray(part.column(0))[text], np.asarray(part.column(1))[text], s, n.astype(np.int32),
                         o.astype(np.int32), _contents(spec, data, words, first, n))
    return run


FINER = pa.schema([*OCC, ("content", pa.binary())])
FINER_SQL = f"{OCC_SQL}, content binary"


def _finer(spec: Spec, gram: int):
    """Pieces (rows of CUT) cut by the anchors of a longer gram, as occurrences
    with their content.  Equal windows of a key have equal anchors again."""
    def run(batches):
        for part, data, off in text_slices(batches, "content"):
            values, at, words = spec.units(data, off)
            piece, s, n, o, key, ph = pieces(values, at, gram, spec.length)
            old, r1, r2, begin = (np.asarray(part.column(part.schema.get_field_index(c)))[piece] for c in ("key", "r1", "r2", "s"))
            key = mix(key + old.view(U64) * U64(0x9E3779B97F4A7C15))
            yield record(FINER, key.view(np.int64), ph.view(np.int64), r1, r2, ((begin + s - at[piece]) * PLACE + n) * PLACE + o,
                         _contents(spec, data, words, s, n))
    return run


def longer_gram(gram: int, length: int) -> int:
    """The next length of grams: a quarter of what a window has beyond the gram
    is left, or nothing."""
    rest = (length - gram) // 4
    return length - rest if rest >= 4 else length


RUNS = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
RUNS_SQL = "r1 long, r2 long, a long, b long"


def _compare(spec: Spec, first: bool):
    """Chunks of complete groups (rows sorted by key and place) to the runs of
    units that repeat."""
    def out(rows: pa.Table):
        key, r1, r2, s = (np.asarray(rows[c]) for c in ("key", "r1", "r2", "s"))
        # equal rows of the documents bring the same place twice
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]) | (s[1:] != s[:-1])
        if not new.all():
            rows, r1, r2, s = rows.filter(pa.array(new)), r1[new], r2[new], s[new]
        piece, a, b = spec.match(spec, rows, first)
        t = pa.array(piece)
        return record(RUNS, pa.array(r1).take(t), pa.array(r2).take(t), s[piece] + a, s[piece] + b)

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size < CHUNK_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = np.asarray(rows["key"])
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1     # the last key may go on in the next batch
            done, lo = 0, 0
            content = np.cumsum(np.asarray(pc.binary_length(rows["content"]).fill_null(0)).astype(np.int64))
            for e in edge.tolist():
                if content[e - 1] - (content[lo - 1] if lo else 0) >= CHUNK_BYTES // 2 or e == edge[-1]:
                    yield out(rows.slice(lo, e - lo))
                    lo = done = e
            held = rows.slice(done).to_batches()
            size = sum(x.nbytes for x in held) if done else 0
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks())
    return run


def repeated_runs(docs: DataFrame, spec: Spec, keep_first: bool = False, max_group: int = MAX_GROUP) -> DataFrame:
    """r1, r2, runs: for each text with any, the runs (structs a, b: first unit
    and last + 1, may overlap) covered by windows that also start elsewhere, or
    with ``keep_first`` that also start earlier (smaller id, then row key, then
    position).  ``docs`` has r1, r2, text (``keyed``).  With ``keep_first`` rows
    equal in id and text count as one document."""
    if not 1 <= spec.gram <= spec.length < PLACE:
        raise ValueError(f"windows of 1 to {PLACE - 1} units, grams no longer than windows")
    docs, gram = docs.select("r1", "r2", "text"), spec.gram
    place = F.struct("r2", "r1", "p")
    s, n = F.shiftright("p", 24), F.shiftright("p", 12).bitwiseAND(F.lit(PLACE - 1))
    whole = F.struct(s.alias("a"), (s + n + (spec.length - 1)).alias("b")).alias("run")
    runs, cut = [], None
    while True:
        occ = docs.mapInArrow(_occurrences(spec), OCC_SQL) if cut is None else saved(cut.where("hot").mapInArrow(_finer(spec, gram), FINER_SQL))
        known = (occ.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("ph").alias("lo"), F.max("ph").alias("hi"))
                 .where("c > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed")))
        # written first: a join of two plain shuffles is one whose hot keys adaptive
        # execution splits, a join with an aggregate in the same stage is not
        found = saved(occ.join(saved(known), "key"))
        equal = found.where(~F.col("mixed"))
        if keep_first:
            equal = equal.join(saved(equal.groupBy("key").agg(F.min(place).alias("f"))), "key").where(place > F.col("f"))
        runs.append(equal.select("r1", "r2", whole))
        # mixed grams: equal pieces collapse to their first place
        mixed = found.where("mixed")
        same = saved(mixed.groupBy("key", "ph").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("f")))
        many = saved(same.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > max_group).select("key", F.lit(True).alias("hot")))
        mixed = saved(mixed.join(same, ["key", "ph"]).join(many, "key", "left")
                      .select("key", "r1", "r2", "p", *([] if cut is None else ["content"]), F.coalesce("hot", F.lit(False)).alias("hot"),
                              (F.col("c") > 1).alias("more"), (place == F.col("f")).alias("lead")))
        runs.append(mixed.where(~F.col("lead") if keep_first else F.col("more")).select("r1", "r2", whole))
        if gram == spec.length:     # a piece is a window: different ones share nothing
            break
        lead = mixed.where("lead")
        if cut is None:
            want = lead.groupBy("r1", "r2").agg(F.collect_set(F.struct("key", "p", "hot")).alias("want"))
            cut = saved(packed(docs).join(want, ["r1", "r2"]).mapInArrow(_cut(spec), CUT_SQL))
        else:
            cut = lead.select("key", "hot", "r1", "r2", s.alias("s"), n.cast("int").alias("n"),
                              F.col("p").bitwiseAND(F.lit(PLACE - 1)).cast("int").alias("o"), "content")
        cool = cut.where(~F.col("hot")).drop("hot").repartition("key").sortWithinPartitions("key", "r2", "r1", "s")
        runs.append(cool.mapInArrow(_compare(spec, keep_first), RUNS_SQL).select("r1", "r2", F.struct("a", "b").alias("run")))
        if many.isEmpty():
            break
        gram = longer_gram(gram, spec.length)
    return functools.reduce(DataFrame.unionByName, runs).groupBy("r1", "r2").agg(F.collect_set("run").alias("runs"))


def merged(flat: np.ndarray, n: int) -> np.ndarray:
    """Maximal runs [[a, b], ...] of the union of [a, b) rows, within n units."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, flat[:, 0], 1)
    np.add.at(steps, np.minimum(flat[:, 1], n), -1)
    on = np.concatenate([[0], (np.cumsum(steps[:-1]) > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(on)).reshape(-1, 2)


def texts_with_runs(docs: DataFrame, spec: Spec, keep_first: bool, max_group: int) -> DataFrame:
    """docs (``keyed``) with z, the packed text, and runs; every row stays."""
    return packed(docs).join(repeated_runs(docs, spec, keep_first, max_group), ["r1", "r2"], "left")


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """r1, r2, the ``more`` columns, text: r1 is a hash of the text, r2 the id
    (null: the largest number, so it comes last).  Rows equal in both are
    copies of one document and get the same runs."""
    text, i = named(text_col).cast("string"), named(id_col).cast("long")
    return docs.select(F.xxhash64(text).alias("r1"), F.coalesce(i, F.lit((1 << 63) - 1)).alias("r2"), *more, text.alias("text"))


def run_rows(part: pa.RecordBatch, column: str = "runs") -> list[np.ndarray | None]:
    """The runs of each row as [a, b] rows, None where there are none."""
    col = part.column(part.schema.get_field_index(column))
    lens = np.asarray(col.value_lengths().fill_null(0))
    flat = col.flatten()
    ab = np.stack([np.asarray(flat.field(0)), np.asarray(flat.field(1))], axis=1).astype(np.int64) if len(flat) else np.zeros((0, 2), np.int64)
    end = np.cumsum(lens)
    return [ab[e - n:e] if n else None for e, n in zip(end.tolist(), lens.tolist())]
