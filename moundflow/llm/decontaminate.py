"""Benchmark decontamination: broadcast hash set of normalised test n-grams,
a scan of every document's word windows, exact verification of the hits."""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundflow.llm.base import (ALNUM_LOWER, LOWER, Rolling, Words, free, id_text, named, numbered, record, row_key, saved, shared,
                                text_slices)

WINDOW = 10
#: Bytes of item texts in one broadcast block.  A larger benchmark is taken in
#: several blocks, each with its own scan of the documents: the blocks are the
#: way beyond the bound, nothing is left out.
BLOCK_BYTES = 4 << 20
_ROLL = Rolling(0xC2B2AE3D27D4EB4F)


def _window_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that stay inside one text, and their first words."""
    if len(w) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = _ROLL.grams(_ROLL.prefix(w.h), n)
    owner = w.owner()
    ok = np.flatnonzero(owner[:len(h)] == owner[n - 1:])
    return h[ok] + np.uint64(n), ok


class Grams:
    """The windows of a block of benchmark items, by hash: window words, items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        texts = [(t or "").encode() for _, t in items]
        data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        w = Words(data, off, ALNUM_LOWER)
        counts = w.counts()
        self.lengths = sorted({min(int(c), window) for c in counts if c})
        self.windows: dict[int, list[tuple[bytes, set[str]]]] = {}
        raw = data.tobytes()
        for n in self.lengths:
            h, first = _window_hashes(w, n)
            owner = w.owner()[first]
            fits = counts[owner] == n if n < window else np.ones(len(h), bool)
            for x, i, o in zip(h[fits].tolist(), first[fits].tolist(), owner[fits].tolist()):
                words = b" ".join(raw[a:b] for a, b in zip(w.s[i:i + n].tolist(), w.e[i:i + n].tolist()))
                for known, ids in (bucket := self.windows.setdefault(x, [])):
                    if known == words:
                        break
                else:
                    bucket.append((words, ids := set()))
                if items[o][0] is not None:
                    ids.add(items[o][0])
        self.hashes = np.sort(np.fromiter(self.windows, np.uint64, len(self.windows)))
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.hashes & np.uint64(0xFFFF)] = True

    def scan(self, data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, list[set[str]]]:
        """Words of the texts, a mask of the hit ones, and each text's items."""
        data = LOWER[data]
        w = Words(data, off, ALNUM_LOWER)
        hit, found = np.zeros(len(w) + 1, np.int32), [set() for _ in range(len(off) - 1)]
        owner = w.owner()
        for n in self.lengths:
            h, first = _window_hashes(w, n)
            maybe = np.flatnonzero(self.bits[h & np.uint64(0xFFFF)])
            at = np.searchsorted(self.hashes, h[maybe])
            at[at == len(self.hashes)] = 0
            maybe = maybe[self.hashes[at] == h[maybe]] if len(self.hashes) else maybe[:0]
            for x, i in zip(h[maybe].tolist(), first[maybe].tolist()):
                words = b" ".join(data[a:b].tobytes() for a, b in zip(w.s[i:i + n].tolist(), w.e[i:i + n].tolist()))
                for known, ids in self.windows[x]:
                    if known == words:      # verified: the words, not just their hash
                        hit[i] += 1
                        hit[i + n] -= 1
                        found[owner[i]] |= ids
        return w, np.cumsum(hit[:-1]) > 0, found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Grams]:
    """Blocks of items, cut by a running size in item order; one block at a
    time is on the driver."""
    from pyspark.sql import Window
    b = id_text(benchmark, id_col, text_col).where(F.length("text") > 0).select(F.col("doc_id").cast("string").alias("i"), "text")
    size, n = b.agg(F.sum(F.octet_length("text")), F.count("text")).first()
    if not n:
        return
    if size <= block_bytes:
        yield Grams([tuple(r) for r in b.collect()], window)
        return
    # larger: items are dealt by hash into enough groups that each is about half a block
    groups = 2 * (-(-size // block_bytes))
    dealt = saved(b.withColumn("g", F.pmod(F.xxhash64("i", "text"), F.lit(groups))))
    sizes = dict(dealt.groupBy("g").agg(F.sum(F.octet_length("text"))).collect())
    for g in sorted(sizes):
        if sizes[g] <= 2 * block_bytes:
            yield Grams([tuple(r) for r in dealt.where(F.col("g") == g).select("i", "text").collect()], window)
            continue
        order = Window.partitionBy("g").orderBy("i", "text").rowsBetween(Window.unboundedPreceding, 0)
        cut = dealt.where(F.col("g") == g).withColumn("k", F.floor(F.sum(F.octet_length("text")).over(order) / block_bytes))
        for k, in sorted(cut.select("k").distinct().collect()):
            yield Grams([tuple(r) for r in cut.where(F.col("k") == k).select("i", "text").collect()], window)


SCAN = pa.schema([("doc_id", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("n_words", pa.int64()),
                  ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _scan(docs: DataFrame, grams: Grams, keep_all: bool) -> DataFrame:
    """Per document: words, first and last + 1 words of each hit run (flat), items."""
    get = shared(docs, grams)

    def run(batches):
        for part, data, off in text_slices(batches):
            w, hit, found = get().scan(data, off)
            rows = [_runs(hit[a:b]).tolist() for a, b in zip(w.off[:-1], w.off[1:])]
            yield record(SCAN, part.column(0), part.column(2), part.column(3), w.counts(), rows, [sorted(x) for x in found])

    out = docs.mapInArrow(run, "doc_id long, r1 long, r2 long, n_words long, hits array<int>, items array<string>")
    return out if keep_all else out.where(F.size("hits") > 0)


def _runs(mask: np.ndarray) -> np.ndarray:
    """[start, end, start, end, ...] of the set runs."""
    if not mask.any():
        return np.zeros(0, np.int32)
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).astype(np.int32)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of overlapping [start, end, ...] runs, found in different blocks."""
    for b in batches:
        at = b.schema.get_field_index("hits")
        rows = []
        for flat in b.column(at).to_pylist():
            steps = np.zeros(max(flat, default=0) + 1, np.int32)
            np.add.at(steps, flat[0::2], 1)
            np.add.at(steps, flat[1::2], -1)
            rows.append(_runs(np.cumsum(steps) > 0).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(rows, c.type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
              id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), hits (flat word bounds of the
    hit runs) for every document row.

    Null and empty texts have no words and no hits; null or wordless items have
    no windows; equal items or windows count once per item id, an item without
    an id hits words but is not listed; repeated document rows are judged one
    by one.  The documents are scanned once per block of items and not shuffled
    (unless there are several blocks: then the hits, not the texts, are merged)."""
    d = id_text(docs, id_col, text_col)
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key(F.col("doc_id"), F.col("text")))
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    first = next(blocks, None) or Grams([], window)
    out, rest = _scan(d, first, True), [_scan(d, g, False) for g in blocks]
    if rest:
        more = rest[0]
        for x in rest[1:]:
            more = more.unionByName(x)
        more = more.groupBy("r1", "r2").agg(F.flatten(F.collect_set("hits")).alias("more"),
                                            F.array_distinct(F.flatten(F.collect_set("items"))).alias("also"))
        out = out.join(more, ["r1", "r2"], "left").select(
            "doc_id", "r1", "r2", "n_words", F.concat("hits", F.coalesce("more", F.array().cast("array<int>"))).alias("hits"),
            F.array_sort(F.array_distinct(F.concat("items", F.coalesce("also", F.array().cast("array<string>"))))).alias("items"))
        out = out.mapInArrow(_merge, out.schema)
    signed = F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return out.select("doc_id", "n_words", F.aggregate(signed, F.lit(0), lambda a, x: a + x).cast("long").alias("n_hit"), "items", "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "remove", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, same columns, without benchmark passages: ``remove``
    drops hit documents, ``cut`` drops the hit words' bytes with what stands
    between them, and keeps the rest of the text as it is.  Texts without a
    hit, null ones included, come back unchanged."""
    if action not in ("remove", "cut"):
        raise ValueError(action)
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None or action == "remove":        # what one block takes does not change what another would
        out = _cut(docs, first, text_col, action)
        for grams in [] if second is None else itertools.chain([second], blocks):
            out = _cut(out, grams, text_col, action)
        return out
    d = id_text(docs, id_col, text_col).select(F.lit(0).cast("long").alias("doc_id"), "text", *row_key(F.col("doc_id"), F.col("text")))
    found = None
    for grams in itertools.chain([first, second], blocks):
        one = _scan(d, grams, False).select("r1", "r2", "hits")
        found = one if found is None else found.unionByName(one)
    return _cut_runs(docs, saved(found.groupBy("r1", "r2").agg(F.flatten(F.collect_set("hits")).alias("hits"))), id_col, text_col)


def _cut_runs(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents without the words of the runs that all blocks found in them."""
    names = docs.columns
    k1, k2, runs = free(docs, "__r1"), free(docs, "__r2"), free(docs, "__runs")
    t = named(text_col).cast("string")
    keys = [k.alias(n) for k, n in zip(row_key(named(id_col), t), (k1, k2))]
    d = docs.select(*map(named, names), *keys).join(hits.select(F.col("r1").alias(k1), F.col("r2").alias(k2), F.col("hits").alias(runs)), [k1, k2], "left")
    d = numbered(d.select(*map(named, names), runs))
    at, last = names.index(text_col), len(names)

    def run(batches):
        for part, data, off in text_slices(batches, f"c{at}"):
            flat = part.column(last).to_pylist()
            own = pa.RecordBatch.from_arrays(part.columns[:last], names=part.schema.names[:last])
            if any(flat):
                w, texts = Words(LOWER[data], off, ALNUM_LOWER, hashes=False), own.column(at).to_pylist()
                for i, edges in enumerate(flat):
                    if edges:
                        steps = np.zeros(max(edges) + 1, np.int32)
                        np.add.at(steps, edges[0::2], 1)
                        np.add.at(steps, edges[1::2], -1)
                        texts[i] = _without(data, off, w, i, _runs(np.cumsum(steps) > 0))
                own = pa.RecordBatch.from_arrays([pa.array(texts, c.type) if i == at else c for i, c in enumerate(own.columns)], schema=own.schema)
            yield own

    return d.mapInArrow(run, d.select(*[f"c{i}" for i in range(last)]).schema).toDF(*names)


def _without(data: np.ndarray, off: np.ndarray, w: Words, d: int, edges: np.ndarray) -> str:
    """Text d without the bytes of its words in the runs and what stands between these."""
    raw, kept, last = data[off[d]:off[d + 1]].tobytes(), [], 0
    for a, b in edges.reshape(-1, 2).tolist():
        kept.append(raw[last:w.s[w.off[d] + a] - off[d]])
        last = int(w.e[w.off[d] + b - 1] - off[d])
    return b"".join([*kept, raw[last:]]).decode()


def _cut(docs: DataFrame, grams: Grams, text_col: str, action: str) -> DataFrame:
    get, names = shared(docs, grams), docs.columns
    docs, text_col = numbered(docs), f"c{names.index(text_col)}"

    def run(batches):
        for part, data, off in text_slices(batches, text_col):
            w, hit, _ = get().scan(data, off)
            n = np.concatenate([[0], np.cumsum(hit)])
            dirty = n[w.off[1:]] > n[w.off[:-1]]
            if not dirty.any():
                yield part
                continue
            if action == "remove":
                yield part.filter(pa.array(~dirty))
                continue
            at = part.schema.get_field_index(text_col)
            texts = part.column(at).to_pylist()
            for d in np.flatnonzero(dirty):
                texts[d] = _without(data, off, w, d, _runs(hit[w.off[d]:w.off[d + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def digest(hits: DataFrame) -> DataFrame:
    """The digest columns of find_hits."""
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bl),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, CAST(i + n AS BIGINT))) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
