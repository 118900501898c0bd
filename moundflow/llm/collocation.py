"""Phrases that stand together more often than their parts, per language.

Frequent n-grams are found in two passes.  The first hashes every n-gram, counts
each block of a task exactly and deals the counts by hash partition, where they
are merged into one Misra-Gries summary.  Its capacity exceeds the partition's
mass divided by the threshold, so what all its decrements take from a counter
stays below the threshold and every frequent n-gram survives.  The second pass
counts exactly, by the phrases themselves, whatever hits the survivors' bits."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundflow.llm.base import BYTE_VALUE, LOWER, U64, Rolling, byte_class, mix, named, record, saved, shared, spans, text_slices
from moundflow.session import task_slots

#: Occurrences that one hash partition shall have about; n-grams that a task counts at
#: once, by hash (a block of 8 MB) and then by phrase.
MASS, BLOCK, PHRASES = 1 << 25, 1 << 20, 1 << 19
#: Bytes of text hashed at once.
SLICE = 1 << 19
#: Bits of the survivors' filter are at most 2 to this power (64 MB).  A fuller
#: filter lets more n-grams through to the exact count and changes no result.
FILTER_POWER = 29
CUTS = byte_class((0x0A, 0x0D))
CUTS[list(b".,;:!?")] = True
WORD = ~(CUTS | byte_class((0x20, 0x20), (0x09, 0x09)))
_roll_bytes, _roll_words = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)


# --- n-grams of a slice of texts -------------------------------------------------------

class Grams:
    """Word sequences of 1 to ``longest`` words inside pieces: for each length k
    their first words ``at[k]`` and 64-bit hashes ``h[k]`` (of words and language)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: np.ndarray, longest: int):
        self.data = LOWER[data]
        member = WORD[self.data]
        self.s, self.e, first = spans(member, off)
        cuts = np.zeros(len(data) + 1, np.int64)
        np.cumsum(CUTS[self.data], out=cuts[1:])
        owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
        self.owner, self.n = owner, len(self.s)
        words = _roll_bytes.runs(_roll_bytes.prefix(BYTE_VALUE[self.data]), self.s, self.e)
        prefix = _roll_words.prefix(words)
        # words stand in the same piece where no cut and no end of a text lies between
        piece = cuts[self.s]
        self.at, self.h = {}, {}
        for k in range(1, longest + 1):
            n = max(0, self.n - k + 1)
            ok = np.flatnonzero((piece[k - 1:] == piece[:n]) & (owner[k - 1:] == owner[:n])) if n else np.zeros(0, np.int64)
            self.at[k] = ok
            self.h[k] = mix(_roll_words.raw_grams(prefix, k)[ok] * U64(2 * k + 1) ^ langs[owner[ok]]) if len(ok) else np.zeros(0, U64)

    def phrases(self, k: int, at: np.ndarray) -> pa.Array:
        """The words from each place on, joined by one space."""
        n = len(self.data)
        keep = np.zeros(n + 1, bool)
        keep[:n] = WORD[self.data]
        keep[self.e] = True                     # one separator after each word
        text = np.append(self.data, np.uint8(0x20))
        text = np.where(WORD[text], text, np.uint8(0x20))[keep]
        place = np.zeros(n + 2, np.int64)
        np.cumsum(keep, out=place[1:])
        a, b = place[self.s[at]], place[self.e[at + k - 1]]
        off = np.zeros(len(at) + 1, np.int64)
        np.cumsum(b - a, out=off[1:])
        data = text[np.arange(off[-1]) + np.repeat(a - off[:-1], b - a)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data))


def _slices(batches: Iterator[pa.RecordBatch], longest: int):
    for part, data, off in text_slices(batches, limit=SLICE):
        names, codes = np.unique(np.array([x.encode() for x in part.column(0).to_pylist()], object), return_inverse=True)
        salt = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in names], U64)
        yield Grams(data, off, salt[codes], longest), [x.decode() for x in names], codes


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit keys and their summed counts (which stop at 2**31)."""
    packed = keys.astype(U64) << U64(32)
    packed |= np.minimum(counts, 1 << 31).astype(U64) if counts is not None else U64(1)
    packed.sort()
    k = (packed >> U64(32)).astype(np.uint32)
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    sums = np.add.reduceat((packed & U64(0xFFFFFFFF)).astype(np.int64), at) if len(k) else np.zeros(0, np.int64)
    return k[at], np.minimum(sums, 1 << 31)


class Summary:
    """A Misra-Gries summary of the given capacity; merging adds counters and, where
    there are too many, takes the largest that does not fit from all of them.
    ``taken`` is what any counter has lost at most: less than mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = tally(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        over = len(self.counts) - self.capacity
        if over > 0:
            least = int(np.partition(self.counts, over - 1)[over - 1])
            stays = self.counts > least
            self.keys, self.counts, self.taken = self.keys[stays], self.counts[stays] - least, self.taken + least

    def may_reach(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.taken >= threshold]


# --- first pass --------------------------------------------------------------------------

_BLOB = pa.schema([("p", pa.int32()), ("mass", pa.int64()), ("ones", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])


def _count_blocks(longest: int, power: int):
    """Counts of blocks by hash partition (the first ``power`` bits of a hash; the
    next 32 are the key).  Each block gives its masses apart from its counts."""
    starts = np.arange(1 << power).astype(U64) << U64(32)

    def emit(h: np.ndarray):
        h >>= U64(32 - power)
        h.sort()
        ends = np.append(np.searchsorted(h, starts), len(h))
        rows = []
        # a partition at a time: what is made beside the block is a part of it
        for i in np.flatnonzero(np.diff(ends)).tolist():
            x = h[ends[i]:ends[i + 1]].astype(np.uint32)
            at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            k, c = x[at], np.diff(np.append(at, len(x)))
            one = c == 1
            rows += [(i, len(x), None, None, None), (i, None, k[one].tobytes(), k[~one].tobytes(), c[~one].astype(np.uint32).tobytes())]
        return record(_BLOB, *map(list, zip(*rows)))

    def run(batches):
        block, size = np.empty(BLOCK, U64), 0
        for g, _, _ in _slices(batches, longest):
            for x in g.h.values():
                a = 0
                while a < len(x):
                    n = min(len(x) - a, BLOCK - size)
                    block[size:size + n] = x[a:a + n]
                    a, size = a + n, size + n
                    if size == BLOCK:
                        yield emit(block)
                        size = 0
        if size:
            yield emit(block[:size])
    return run


def _merge_blocks(threshold: int, slack: int, low: int):
    """Per hash partition its masses (which come first), then the merged summary;
    gives the partition's stretch of the filter, of 2**low bits."""
    def run(batches):
        now, mass, summary, keys, counts, size = None, 0, None, [], [], 0

        def merge():
            nonlocal keys, counts, size
            if size:
                summary.merge(np.concatenate(keys), np.concatenate(counts))
            keys, counts, size = [], [], 0

        def done():
            merge()
            found = summary.may_reach(threshold)
            bits = np.zeros(1 << low, bool)
            bits[found >> np.uint32(32 - low)] = True
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([mass]), pa.array([len(found)]), pa.array([summary.taken]),
                                               pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                                              names=["p", "mass", "found", "taken", "bits"])

        for b in batches:
            for p, m, ones, more, n in zip(*[c.to_pylist() for c in b.columns]):
                if p != now:
                    if now is not None:
                        yield done()
                    now, mass, summary = p, 0, None
                if m is not None:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(slack * mass // threshold + 1)
                a, z = np.frombuffer(ones, np.uint32), np.frombuffer(more, np.uint32)
                keys += [a, z]
                counts += [np.ones(len(a), np.int64), np.frombuffer(n, np.uint32).astype(np.int64)]
                size += len(a) + len(z)
                if size >= max(summary.capacity, 1 << 20):
                    merge()
        if now is not None:
            yield done()
    return run


class Filter:
    """Bits of the hashes that may be frequent, by a hash's first ``power`` bits."""

    def __init__(self, power: int, bits: np.ndarray):
        self.power, self.bits = power, bits

    def hits(self, h: np.ndarray) -> np.ndarray:
        at = (h >> U64(64 - self.power)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def survivors(docs: DataFrame, longest: int, threshold: int, mass: int = MASS, slack: int = 2) -> DataFrame:
    """p, mass, found, taken and the filter's bits of every hash partition."""
    total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * longest // 6 + 1     # a word and its space take about six bytes
    parts = max(total // mass, min(4 * task_slots(docs.sparkSession, 1), total >> 20), 1)
    power = min(24, math.ceil(math.log2(parts)))
    low = max(3, min(FILTER_POWER, math.ceil(math.log2(4 * total / threshold + 16))) - power)
    blobs = docs.mapInArrow(_count_blocks(longest, power), "p int, mass long, ones binary, more binary, counts binary")
    ordered = blobs.repartition("p").sortWithinPartitions("p", F.col("mass").asc_nulls_last())
    got = saved(ordered.mapInArrow(_merge_blocks(threshold, slack, low), "p int, mass long, found long, taken long, bits binary"))
    return got.withColumns({"power": F.lit(power), "low": F.lit(low)})


def make_filter(found: DataFrame) -> Filter | None:
    """The whole filter, at most 2**FILTER_POWER bits and so the size that is
    collected and broadcast; None where no n-gram was met."""
    rows = found.select("p", "bits", "power", "low").collect()
    if not rows:
        return None
    power, low = rows[0].power, rows[0].low
    bits = np.zeros(1 << power + low - 3, np.uint8)
    for r in rows:
        bits[r.p << low - 3:r.p + 1 << low - 3] = np.frombuffer(r.bits, np.uint8)
    return Filter(power + low, bits)


# --- second pass ---------------------------------------------------------------------------

_COUNT = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _count_phrases(get, longest: int):
    """Counts of the phrases that hit the filter, by block; words in all as k = 0."""
    def emit(held):
        t = pa.Table.from_batches(held).combine_chunks()
        got = t.group_by(["lang", "k", "phrase"]).aggregate([("f", "sum")])
        yield from got.rename_columns(["lang", "k", "phrase", "f"]).select(_COUNT.names).cast(_COUNT).to_batches(max_chunksize=1 << 16)

    def run(batches):
        filt, held, size = get(), [], 0
        for g, names, codes in _slices(batches, longest):
            names = pa.array(names, pa.string())
            words = np.bincount(codes[g.owner], minlength=len(names)) if g.n else np.zeros(len(names), np.int64)
            held.append(record(_COUNT, names, [0] * len(names), [""] * len(names), words))
            for k in range(1, longest + 1):
                hit = filt.hits(g.h[k])
                h, at = g.h[k][hit], g.at[k][hit]
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                h, at = h[order], at[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                n = np.diff(np.append(first, len(h)))
                size += len(first)
                held.append(record(_COUNT, names.take(pa.array(codes[g.owner[at[first]]])), np.full(len(first), k, np.int32), g.phrases(k, at[first]), n))
            if size >= PHRASES:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)
    return run


def frequent_phrases(docs: DataFrame, longest: int = 3, threshold: int = 10, mass: int = MASS, slack: int = 2,
                     lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, k, phrase, f: every sequence of 1 to ``longest`` words that stands
    ``threshold`` times or more in a language, with its exact count; the row of
    k = 0 has the language's words in all."""
    d = docs.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"),
                    F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    filt = make_filter(survivors(d, longest, threshold, mass, slack))
    filt = filt or Filter(3, np.zeros(1, np.uint8))
    got = d.mapInArrow(_count_phrases(shared(d, filt), longest), "lang string, k int, phrase string, f long")
    return got.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= threshold) | (F.col("k") == 0))


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, shortest: int = 2, longest: int = 3, threshold: int = 10, inside: int = 50, top: int = 2000,
                 lang_col: str = "lang", text_col: str = "text", mass: int = MASS, slack: int = 2) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    Texts, lower-cased in A-Z, are cut at marks and line ends; words are what
    stands between spaces and tabs.  A phrase of a occurrences that is cut into
    parts of l and r occurrences scores floor(1,000,000 a a / (l r)), in decimals
    of 38 digits; its lowest cut counts, the first of equal ones.  A phrase inside
    a longer frequent one that has ``inside`` percent of its occurrences goes.
    Ties go by a, then by the phrase's bytes.  A null language is ``und``, a null
    text empty; rows that repeat count each; other columns are not read; an empty
    table gives none."""
    if not 2 <= shortest <= longest:
        raise ValueError("phrases have two words at least")
    found = saved(frequent_phrases(docs, longest, threshold, mass, slack, lang_col, text_col))
    counts = found.where("k > 0").select("lang", "phrase", "f")
    cand = found.where(F.col("k") >= shortest).select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cand.select("lang", "k", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "k", "phrase", "a", "cut", _part(F.col("w"), F.lit(1), F.col("cut")).alias("left"),
                       _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("1000000 * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")
    scored = (cuts.withColumn("score", score).groupBy("lang", "k", "phrase", "a")
              .agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "k", "phrase", "a", "m.l", "m.r", "m.score"))
    longer = (cand.where(F.col("k") > shortest)
              .select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(shortest), F.col("k") - 1)).alias("m"))
              .select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("i"))
              .select("lang", _part(F.col("w"), F.col("i"), F.col("m")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    stays = (scored.join(longer, ["lang", "phrase"], "left")
             .where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * inside)))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stays.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    words = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same over the table ``documents`` as DuckDB SQL.
ORACLE = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\x0C\r]')) AS p FROM texts),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS ks(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cuts AS (SELECT c.lang, c.k, c.phrase, c.f AS a, j, l.f AS l, r.f AS r,
                (1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score
         FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
         JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
         JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(f) AS most FROM (
             SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase FROM f, (VALUES (1), (2)) AS s(i) WHERE k = 3) GROUP BY ALL),
stays AS (SELECT s.* FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase WHERE g.most IS NULL OR 100 * g.most < 50 * s.a)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM stays s JOIN n ON n.lang = s.lang QUALIFY rank <= 2000
"""
