"""SimHash near-dedup: fingerprints of word shingles, candidates that agree on
half their bits, distances counted on vertical bit planes, components."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundflow.llm.base import LOWER, Words, free, id_text, named, record, row_key, saved, text_slices

SHINGLE, RADIUS, SEED = 3, 3, 42
U64 = np.uint64
#: Rows of a tile whose distances are counted together.
TILE = 512
#: Fingerprints of one key that one task compares; larger sets are cut by further bits.
MAX_GROUP = 4096


# --- fingerprints ------------------------------------------------------------

def fingerprints(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: bit set if over half of the shingles' XXH64 have it."""
    import xxhash
    data = LOWER[data]
    w = Words(data, off, hashes=False)
    counts, length = w.counts(), w.e - w.s
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    out = np.zeros(len(off) - 1, U64)
    if not len(w):
        return out
    # all words, one space after each
    at = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(at[-1], 0x20, np.uint8)
    nth = np.repeat(np.arange(len(w)), length)
    joined[np.arange(len(nth)) + nth] = data[np.repeat(w.s - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(len(nth))]
    raw = joined.tobytes()
    first = np.repeat(w.off[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    last = first + np.repeat(np.minimum(counts, shingle), n) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last + 1] - 1).tolist())], U64)
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones > n[some, None], axis=1).reshape(-1).view(U64)
    return out


FP = pa.schema([("doc_id", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("fp", pa.int64())])


def fingerprint_rows(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, r1, r2, fp of every row."""
    i = F.col("doc_id").cast("long")
    d = id_text(docs, id_col, text_col).select(i.alias("doc_id"), *row_key(i, F.col("text")), "text")

    def run(batches):
        for part, data, off in text_slices(batches):
            yield record(FP, *part.columns[:3], fingerprints(data, off, shingle).view(np.int64))

    return d.mapInArrow(run, "doc_id long, r1 long, r2 long, fp long")


# --- distances on bit planes -------------------------------------------------

def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows: plane p holds bit p of all values, 64 values to a word."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, U64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(U64)


def within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query's index, indexes of values within ``radius``).  Every lane's
    distance is a bit-sliced counter; a plane is added to all lanes of all
    queries by a chain of XOR and AND; queries whose lanes all exceed the radius
    are abandoned on the way."""
    width = max(1, (radius + 1 - 1).bit_length())
    full = np.full(planes.shape[1], ~U64(0))
    spare = planes.shape[1] * 64 - n
    tail = np.zeros(planes.shape[1], U64)
    if spare:
        tail[-1] = ~U64(0) << U64(64 - spare)
    alive = np.arange(len(queries))
    q = queries.astype(U64)
    count = [np.zeros((len(q), planes.shape[1]), U64) for _ in range(width)]
    over = np.repeat(tail[None, :], len(q), axis=0)
    for p in range(64):
        add = planes[p][None, :] ^ (U64(0) - ((q >> U64(p)) & U64(1)))[:, None]
        for c in count:
            carry = c & add
            c ^= add
            add = carry
        over |= add                      # the counter wrapped: more than 2**width - 1
        if p % 8 == 7 and p < 63:
            keep = ~(over == full).all(axis=1)
            if not keep.all():
                alive, q, over, count = alive[keep], q[keep], over[keep], [c[keep] for c in count]
                if not len(alive):
                    return
    # counters that did not wrap hold the distance: compare with the radius
    near = ~over
    if radius != (1 << width) - 1:
        less, equal = np.zeros_like(over), np.full_like(over, ~U64(0))
        for b in reversed(range(width)):
            if radius >> b & 1:
                less |= equal & ~count[b]
                equal &= count[b]
            else:
                equal &= ~count[b]
        near &= less | equal
    for i, row in zip(alive.tolist(), near):
        if row.any():
            yield i, np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little")[:n])


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between distinct values within ``radius`` that connect what all
    such links connect: fewer than there are values."""
    values = np.unique(values)
    planes, label, links = bit_planes(values), np.arange(len(values)), []
    step = max(16, (1 << 18) // max(64, len(values)))
    for a in range(0, len(values), step):
        for i, near in within(values[a:a + step], planes, len(values), radius):
            got = label[near]
            low = got.min()
            if got.max() != low:
                for other in np.unique(got)[1:]:
                    j = near[got == other][0]
                    pair = (a + i, int(j)) if label[a + i] != other else (a + i, int(near[got == low][0]))
                    links.append((int(values[pair[0]]), int(values[pair[1]])))
                label[np.isin(label, got)] = low
    return links


# --- candidates --------------------------------------------------------------

def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), parts)]


def _mask(bits) -> int:
    m = sum(1 << int(b) for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def key_masks(radius: int = RADIUS) -> list[int]:
    """Of twice as many blocks as the radius, two values within it agree on as
    many whole blocks as the radius: a key for every such choice (20 for 3)."""
    blocks = _split(list(range(64)), max(1, 2 * radius))
    return [_mask(b for k in c for b in blocks[k]) for c in combinations(range(len(blocks)), max(1, radius))] if radius else [-1]


def sub_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Two values that agree on ``mask`` and are within the radius agree on one
    of radius + 1 parts of the other bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [_mask(p) for p in _split(free, radius + 1)] if free else [0]


def _grouped(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, k, fp), equal (t, k) together: links of the tiles they fill.
    A link between different keys of a tile is a true link as well."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held, size = [], 0

    def out(values):
        links = forest(values.view(U64), radius)
        a = np.array(links, U64).reshape(-1, 2).view(np.int64)
        return record(schema, a.max(axis=1), a.min(axis=1)) if len(a) else None

    last_t = last_k = None
    for b in batches:
        if not b.num_rows:
            continue
        t, k, fp = (np.asarray(b.column(i)) for i in range(3))
        new = np.concatenate([[(t[0], k[0]) != (last_t, last_k)], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        last_t, last_k = t[-1], k[-1]
        starts = np.flatnonzero(new)
        pos = 0
        for s in starts.tolist():
            if size + s - pos >= TILE:      # a tile ends between keys only
                held.append(fp[pos:s])
                if (r := out(np.concatenate(held))) is not None:
                    yield r
                held, size = [], 0
                pos = s
        held.append(fp[pos:])
        size += len(fp) - pos
    if held and (r := out(np.concatenate(held))) is not None:
        yield r


def links(fps: DataFrame, radius: int = RADIUS, max_group: int = MAX_GROUP) -> DataFrame:
    """u, v (u > v as signed numbers): links between distinct fingerprints that
    connect all that are within ``radius`` bits.  ``fps`` has one column fp,
    distinct.

    Keys that more than ``max_group`` fingerprints share are cut by a part of
    their other bits on which linked pairs agree; what then meets agrees on 40
    bits, so there are never more than 2**24 of them in one task, whatever the
    input."""
    masks = key_masks(radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("x.t", "x.k", "fp")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = saved(keyed.join(sizes, ["t", "k"]))
    small = keyed.where(F.col("n") <= max_group).select("t", "k", "fp")
    parts = F.array(*[F.array(*[F.lit(m) for m in sub_masks(x, radius)]) for x in masks])
    large = (keyed.where(F.col("n") > max_group).select("t", "k", "fp", F.posexplode(F.get(parts, F.col("t"))).alias("p", "m"))
             .select((F.col("t") * 16 + F.col("p") + 1000).alias("t"), F.xxhash64("k", F.col("fp").bitwiseAND(F.col("m"))).alias("k"), "fp"))
    both = small.unionByName(large).repartition("t", "k").sortWithinPartitions("t", "k")
    return both.mapInArrow(lambda it: _grouped(it, radius), "u long, v long").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of the links u > v the smallest node it is
    connected with, by alternating large-star and small-star steps.  Each step
    is a minimum per node (partial map-side) and a join; rounds follow the
    logarithm of the components' size."""
    edges, before = saved(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that adaptive execution splits the rows of a large component's centre
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large)
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small)
        sign = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sign


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, r1, r2, fp, root (one fingerprint of the component), component_id
    (smallest doc_id that is reachable over links of at most ``radius``
    differing bits, itself included) per row.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other; equal fingerprints are one node, so copies cost a row each and no
    pairs; a null doc_id is never the smallest unless all of its component are
    null; repeated rows stay."""
    rows = saved(fingerprint_rows(docs, shingle, id_col, text_col))
    node = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(links(node.select("fp"), radius))
    named = node.join(root, node["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = saved(named)
    least = saved(named.groupBy("root").agg(F.min("first").alias("component_id")))
    # the rows of one fingerprint, blank texts say, may be a third of all: both sides are plain tables, so they are split
    return rows.join(saved(named.join(least, "root").select("fp", "root", "component_id")), "fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, same columns, one row of each component: that with the
    smallest id, then row key (null ids last); of equal rows one."""
    k1, k2 = free(docs, "__r1"), free(docs, "__r2")
    r1, r2 = row_key(named(id_col).cast("long"), named(text_col).cast("string"))
    found = near_duplicates(docs, shingle, radius, id_col, text_col)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")).alias("b"))
    keep = best.select(F.col("b.r1").alias(k1), F.col("b.r2").alias(k2))
    return docs.withColumns({k1: r1, k2: r2}).join(keep, [k1, k2], "left_semi").dropDuplicates([k1, k2]).drop(k1, k2)
