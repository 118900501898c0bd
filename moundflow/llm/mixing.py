"""Mixing sources to target weights by a low-discrepancy schedule: points of
a sequence by about the golden ratio fall on cumulative slots, each source's
slots are ranked, and the r-th slot of a source takes its r-th shuffled block of
words, the last one as many words of it as are left to the target."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundflow.llm.base import NOT_SPACE, named, record, saved, spans, text_slices

#: Words of a block.
BLOCK_WORDS = 64
WEIGHTS, SHARE, MAX_REPEAT = (3, 1, 2), 1.5, 2
#: The golden ratio's fractional part and one, in fixed point: products stay exact decimals.
GOLDEN, ONE = 618_033_988_749_894_848, 10**18
#: Slots of a chunk, within which slots are ranked; chunks are added up.
CHUNK = 1 << 14
#: Steps tried on either side of the golden ratio.
STEPS = 500
#: Cells of the line of slots: a point meets only the sources that share its cell.
CELLS = 1 << 12
#: Rows of a shuffle bucket, about.
BUCKET_ROWS = 1 << 14

SIZED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("h", pa.int64()), ("size", pa.int64())])


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, h (a hash of the row), size (words) of every row."""
    i, s, t = named(id_col).cast("long"), named(source_col).cast("string"), named(text_col).cast("string")
    d = docs.select(i.alias("doc_id"), s.alias("source"), F.xxhash64(t, i, s).alias("h"), t.alias("text"))

    def run(batches):
        for part, data, off in text_slices(batches):
            _, _, first = spans(NOT_SPACE[data], off)
            yield record(SIZED, part.column(0), part.column(1), part.column(2), np.diff(first))

    return d.mapInArrow(run, "doc_id long, source string, h long, size long")


def weighted_sources(rows: DataFrame, weights=WEIGHTS) -> DataFrame:
    """source, source_size, n (rows), weight: the weights repeat along the
    sources in code point order, null last.  One row per source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1      # over the sources, not the rows
    return per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds target: ``share`` of all words dealt by weight; a target stops at
    ``max_repeat`` times its source's size and the excess is reshared by weight
    until none is above.  Solved in one pass: sources stop in the order of
    size / weight, and the first that does not stop sets the rate for the rest."""
    cap = max_repeat * F.col("source_size")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = sources.withColumn("__rate", left / rest)
    out = out.withColumn("__nth", F.row_number().over(order))
    rate = F.min(F.when(F.col("__rate") * F.col("weight") <= cap, F.struct("__nth", "__rate"))).over(everything)["__rate"]
    # without a source that does not stop (share >= max_repeat) all take their cap
    return out.withColumn("target", F.least(cap.cast("double"), F.coalesce(rate * F.col("weight"), cap.cast("double")))).drop("__rate", "__nth")


def golden_step(n: int) -> int:
    """A step p without a common factor with n, so i * p mod n meets every
    place once: of those near n times the golden ratio the one whose fraction
    p / n has the smallest terms in sum, which keeps every stretch even."""
    def terms(p: int) -> int:
        out, a, b = 0, n, p
        while b:
            out, a, b = out + a // b, b, a % b
        return out

    near = n * GOLDEN // ONE
    tried = [p for p in range(max(1, near - STEPS), min(n - 1, near + STEPS) + 1) if math.gcd(p, n) == 1]
    return min(tried, key=lambda p: (terms(p), abs(p - near), p), default=1)


def schedule(goal: DataFrame, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """slot, source, rank, block, epoch, words, size: a source has as many
    slots as its target (in whole words) needs, whole epochs and the rest, one
    after the other on a line; slot i of n belongs to the source whose stretch
    holds i * step mod n.  The rank counts the source's slots so far; rank r
    takes block r mod n_blocks in epoch r div n_blocks, all ``size`` words of
    it but in the source's last slot, which takes the first ``words``.

    Slots are dealt to chunks of CHUNK; ranks inside a chunk add to the counts
    of the chunks before, so no window holds all slots of a source."""
    spark = goal.sparkSession
    w = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("source_size")
    line = goal.where("source_size > 0").withColumn("due", F.least(F.round("target").cast("long"), F.floor(max_repeat * size))).where("due > 0")
    line = line.select("source", "source_size", F.ceil(size / block_words).alias("n_blocks"),
                       F.floor(F.col("due") / size).alias("full"), (F.col("due") % size).alias("rest"))
    line = line.withColumn("turns", F.col("full") * F.col("n_blocks") + F.ceil(F.col("rest") / block_words))
    line = line.withColumn("last", F.when(F.col("rest") > 0, (F.col("rest") - 1) % block_words + 1)).drop("full", "rest")
    line = line.withColumn("hi", F.sum("turns").over(w)).withColumn("lo", F.col("hi") - F.col("turns"))
    line = saved(line)
    n = line.agg(F.max("hi")).first()[0] or 0
    cell = n // CELLS + 1
    cells = line.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    point = ((F.col("id") * F.lit(golden_step(n)).cast("decimal(18,0)")) % F.lit(max(n, 1)).cast("decimal(19,0)")).cast("long")
    parts = max(1, -(-n // (8 * CHUNK)))
    slots = (spark.range(0, n, 1, parts).withColumn("id", F.col("id").cast("decimal(19,0)")).withColumn("u", point)
             .select(F.col("id").cast("long").alias("slot"), "u", F.floor(F.col("u") / cell).alias("cell")))
    # CELLS rows and one more per source at most: bounded by the number of sources, which the driver's plan knows
    small = line.count() <= 100_000
    hit = slots.join(F.broadcast(cells) if small else cells, "cell").where("u >= lo and u < hi")
    of = ["n_blocks", "turns", "last", "source_size"]
    hit = hit.select("slot", "source", *of, F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = hit.groupBy("chunk", "source").agg(F.count(F.lit(1)).alias("c"))
    base = counts.select(F.col("chunk").alias("bc"), F.col("source").alias("bs"),
                         (F.sum("c").over(Window.partitionBy("source").orderBy("chunk")) - F.col("c")).alias("base"))
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("chunk", "source").orderBy("slot")) - 1)
    ranked = (ranked.join(base, (F.col("chunk") == F.col("bc")) & F.col("source").eqNullSafe(F.col("bs")))
              .select("slot", "source", *of, (F.col("r") + F.col("base")).alias("rank")))
    ranked = ranked.withColumn("block", F.col("rank") % F.col("n_blocks"))
    ranked = ranked.withColumn("size", F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words))
    words = F.when((F.col("rank") == F.col("turns") - 1) & F.col("last").isNotNull(), F.col("last")).otherwise(F.col("size"))
    return ranked.select("slot", "source", "rank", "block", F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch"), words.alias("words"), "size")


def laid_out(rows: DataFrame, seed: int = 5) -> DataFrame:
    """Adds start: the words of each source, its documents shuffled by hash, as
    one line; a document takes [start, start + size).  Prefix sums go over
    buckets of hashes first and inside a bucket then, so a source of any share
    is spread over tasks.  Rows without words get no place."""
    some = rows.where("size > 0").withColumn("o", F.xxhash64(F.lit(seed), "h"))
    n = some.count()
    buckets = max(1, n // BUCKET_ROWS)
    width = -(-(1 << 64) // buckets)
    b = F.floor((F.col("o").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)")).cast("long")
    some = some.withColumn("b", b)
    sums = some.groupBy("source", "b").agg(F.sum("size").alias("c"))
    base = sums.select(F.col("source").alias("bs"), F.col("b").alias("bb"),
                       (F.sum("c").over(Window.partitionBy("source").orderBy("b")) - F.col("c")).alias("base"))
    inside = some.withColumn("p", F.sum("size").over(
        Window.partitionBy("source", "b").orderBy("o", "doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return (inside.join(base, (F.col("b") == F.col("bb")) & F.col("source").eqNullSafe(F.col("bs")))
            .select("doc_id", "source", "h", "size", (F.col("base") + F.col("p")).alias("start")))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE,
                max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schedule, parts, taken): the order in which blocks are read; which
    words of which document make a block (source, block, doc_id, h, first word,
    words, place in the block); and per document row doc_id, size, source_size, target and taken,
    the words the mix takes from it, repeats counted; a source's sum is its target,
    rounded.

    A null source is a source of its own, after the others.  Null and empty
    texts have size 0 and nothing taken.  Repeated rows take places of their
    own.  An empty table gives three empty ones.  Text is read once, to count
    words; only ids and sizes are shuffled."""
    rows = saved(sizes(docs, id_col, text_col, source_col))
    goal = saved(targets(weighted_sources(rows, weights), share, max_repeat))
    plan = saved(schedule(goal, block_words, max_repeat))
    placed = laid_out(rows)
    end = F.col("start") + F.col("size")
    parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    parts = parts.select("source", "block", "doc_id", "h", "size", "start", (first - F.col("start")).alias("first"),
                         (first - F.col("block") * block_words).alias("at"),
                         (F.least(end, (F.col("block") + 1) * block_words) - first).alias("words"))
    cut = F.col("words") < F.col("size")      # in one slot of a source at most
    times = plan.groupBy(F.col("source").alias("ts"), F.col("block").alias("tb")).agg(
        F.sum(F.when(cut, 0).otherwise(1)).alias("times"), F.max(F.when(cut, F.col("words")).otherwise(0)).alias("some"))
    used = parts.join(times, F.col("source").eqNullSafe(F.col("ts")) & (F.col("block") == F.col("tb")))
    before = F.col("start") + F.col("first") - F.col("block") * block_words      # words of the block before the part
    # (source, start) names a row: each takes places of its own
    got = used.groupBy(F.col("source").alias("gs"), F.col("start").alias("g")).agg(
        F.sum(F.col("words") * F.col("times") + F.greatest(F.lit(0), F.least(F.col("words"), F.col("some") - before))).alias("taken"))
    one = placed.join(got, F.col("source").eqNullSafe(F.col("gs")) & (F.col("start") == F.col("g")), "left").select(
        "doc_id", "source", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    everyone = one.unionByName(rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
    g = goal.select(F.col("source").alias("__s"), "source_size", "target")
    taken = everyone.join(g, F.col("source").eqNullSafe(F.col("__s"))).select("doc_id", "size", "source_size", "target", "taken")
    return plan, parts.drop("size", "start"), taken


def mixed_order(plan: DataFrame, parts: DataFrame) -> DataFrame:
    """The mix itself: slot (the order of reading), source, epoch, and the pieces
    of documents in the slot's block: doc_id, h (which of the rows of that id),
    first word, words; a block that is cut short ends with its slot's words."""
    p = parts.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "doc_id", "h", "first", F.col("words").alias("__w"), F.col("at").alias("__at"))
    got = plan.join(p, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")))
    words = F.least(F.col("__w"), F.col("words") - F.col("__at"))
    return got.where(words > 0).select("slot", "source", "epoch", "block", "doc_id", "h", "first", words.alias("words"), F.col("__at").alias("at"))
