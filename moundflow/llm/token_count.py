"""Token counts with a public tokenizer.  Short texts are encoded whole; huge
ones as overlapping chunks that are encoded with offsets, in parallel, and
spliced where both neighbours prove the same boundary."""
from __future__ import annotations

import bisect
import json
import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundflow.llm.base import id_text, record, saved

#: Characters of a chunk, and of its first overlap with the chunk before.
CHUNK, OVERLAP = 65_536, 1_024
#: Characters before a chunk's end whose tokens may depend on what was cut off:
#: a special string that is cut, or the look-ahead of the splitting pattern.
MARGIN = 32
LIMIT = 512
#: Token counts of units kept by a worker (a memory bound, not a cap on texts).
MEMO = 400_000


def default_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Encoder:
    """The tokenizer of a file, with the counts of units seen before.

    A unit is what stands between lone spaces or lone line ends that have
    characters other than white space on both sides.  The byte-level splitting
    pattern always breaks before such a space and around such a line end, and no
    special string holds either, so units are encoded independently and their
    counts add up to the whole text's (tests hold this against the library).
    Other kinds of tokenizer encode whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.by_units = byte_level(path)
        self.head: dict[str, int] = {}      # a unit as it is
        self.mid: dict[str, int] = {}       # after a space

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder per worker process and file: its memo serves later tasks."""
        home = sys.modules.setdefault("_moundflow_encoders", types.ModuleType("_moundflow_encoders"))
        if path not in home.__dict__:
            setattr(home, path, cls(path))
        return getattr(home, path)

    def encode_counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for i in range(0, len(texts), 4096)
                for e in self.tok.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)]

    def _learn(self, memo: dict[str, int], units: set[str], before: str) -> None:
        new = [u for u in units if u not in memo]
        memo.update(zip(new, self.encode_counts([before + u for u in new])))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_units:
            return self.encode_counts(texts)
        for memo in (self.head, self.mid):
            if len(memo) > MEMO:
                memo.clear()
        heads, mids, ends = [], [], []
        for t in texts:
            h, m, n = units(t)
            heads.append(h)
            mids.append(m)
            ends.append(n)
        self._learn(self.head, {u for h in heads for u in h} | {"\n"}, "")
        self._learn(self.mid, {u for m in mids for u in m}, " ")
        head, mid, line = self.head.__getitem__, self.mid.__getitem__, self.head["\n"]
        return [sum(map(head, h)) + sum(map(mid, m)) + n * line for h, m, n in zip(heads, mids, ends)]

    def chunk(self, text: str) -> tuple[int, list[int], list[int]]:
        """Tokens of a chunk, the offsets of its certain boundaries and the
        tokens before each.  A boundary counts from the second pre-token on, where
        one begins at a word or mark or the one space before it: a neighbour that
        also breaks there continues in the same way, whatever stood before."""
        e = self.tok.encode(text, add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        at, before = [], []
        for i in range(1, len(words)):
            if words[i] != words[i - 1] and words[i - 1] is not None and words[i] is not None and at_start(text, offsets[i][0]):
                at.append(offsets[i][0])
                before.append(i)
        first = bisect.bisect_right(at, offsets[0][1] + 1) if offsets else 0
        return len(e.ids), at[first:], before[first:]


def at_start(text: str, x: int) -> bool:
    """A character that is not white space, or the one space before such a one."""
    return x + 1 < len(text) and (not text[x].isspace() or text[x] == " " and not text[x + 1].isspace())


#: Boundaries between units, for texts with any other white space.
_BREAK = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def units(text: str) -> tuple[list[str], list[str], int]:
    """Units as they are, units after a space (without it), lone line ends."""
    words = text.split()
    n = len(words) - 1
    if n >= 0 and sum(map(len, words)) + n == len(text) and text.count(" ") + text.count("\n") == n:
        head, mid = [], []
        lines = text.split("\n")
        for line in lines:
            first, *rest = line.split(" ")
            head.append(first)
            mid += rest
        return head, mid, len(lines) - 1
    return [u for u in _BREAK.split(text) if u], [], 0


def byte_level(path: str) -> bool:
    """Whether a tokenizer file splits texts by the byte-level pattern alone."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    p = j.get("pre_tokenizer") or {}
    return (p.get("type") == "ByteLevel" and p.get("use_regex", True) and not p.get("add_prefix_space") and not j.get("normalizer")
            and not any(a.get("lstrip") or a.get("rstrip") or re.search(r"\s", a["content"]) or len(a["content"]) >= MARGIN
                        for a in j.get("added_tokens", [])))


SHORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
PIECE = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("k", pa.int32()), ("n", pa.int64()), ("lo", pa.int64()),
                   ("hi", pa.int64()), ("at", pa.list_(pa.int64())), ("before", pa.list_(pa.int64()))])


def _short(path: str):
    def run(batches):
        enc = Encoder.of(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                p = b.slice(i, 256)
                yield record(SHORT, p.column(0), p.column(1), enc.counts([t or "" for t in p.column(2).to_pylist()]))
    return run


def _pieces(path: str, overlap: int):
    """Chunks to their tokens, the end they are sure of, and the boundaries in
    their two overlap zones."""
    def run(batches):
        enc = Encoder.of(path)
        for b in batches:
            for r1, r2, k, lo, last, text in zip(*[c.to_pylist() for c in b.columns]):
                n, at, before = enc.chunk(text)
                hi = lo + len(text)
                sure = hi if last else hi - MARGIN
                zone = [(x + lo, c) for x, c in zip(at, before) if x + lo <= sure and (x < overlap or x + lo >= hi - overlap)]
                yield record(PIECE, [r1], [r2], [k], [n], [lo], [hi], [[x for x, _ in zone]], [[c for _, c in zone]])
    return run


CUT = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("k", pa.int32()), ("lo", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])


def _chunks(chunk: int, overlap: int):
    """A text as chunks, each with the overlap before it: one pass over the text."""
    def run(batches):
        for b in batches:
            for r1, r2, text in zip(*[c.to_pylist() for c in b.columns]):
                for k in range(-(-len(text) // chunk)):
                    lo = max(0, k * chunk - overlap)
                    yield record(CUT, [r1], [r2], [k], [lo], [(k + 1) * chunk >= len(text)], [text[lo:(k + 1) * chunk]])
    return run


def _splice(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """r1, r2, n_tokens (null where some neighbours share no boundary)."""
    cut = long.select("r1", "r2", "text").mapInArrow(_chunks(chunk, overlap), "r1 long, r2 long, k int, lo long, last boolean, text string")
    # the chunks of one huge text are spread over the tasks
    cut = cut.repartition(F.xxhash64("r1", "r2", "k"))
    got = cut.mapInArrow(_pieces(path, overlap), "r1 long, r2 long, k int, n long, lo long, hi long, at array<long>, before array<long>")
    from pyspark.sql import Window
    w = Window.partitionBy("r1", "r2").orderBy("k")      # a row per 65,536 characters of one text
    got = got.withColumns({"p_at": F.lag("at").over(w), "p_before": F.lag("before").over(w)})
    common = F.array_min(F.array_intersect("p_at", "at"))
    got = got.withColumn("x", F.when(F.col("k") > 0, common))
    skip = F.element_at("before", F.array_position("at", F.col("x")).cast("int"))
    upto = F.element_at("p_before", F.array_position("p_at", F.col("x")).cast("int"))
    # tokens of this chunk from the boundary on, and what the chunk before has from it on is taken off
    got = got.withColumns({"own": F.when(F.col("k") == 0, F.col("n")).otherwise(F.col("n") - skip),
                           "cut": F.when(F.col("k") == 0, 0).otherwise(F.lag("n").over(w) - upto)})
    return got.groupBy("r1", "r2").agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own") - F.sum("cut")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null and empty texts have no bytes and no tokens; repeated rows are counted
    each (a huge text that is repeated is encoded once).  Texts over ``chunk``
    characters are encoded as chunks that overlap by ``overlap``; where two
    neighbours share no certain boundary the overlap doubles, up to the whole
    text, so the count always equals that of the whole text."""
    path = path or default_path()
    if not byte_level(path):
        chunk = (1 << 31) - 1       # no boundary is certain: whole texts
    if not MARGIN < overlap <= chunk // 2:
        raise ValueError(f"overlap must exceed {MARGIN} characters and be at most half a chunk")
    d = id_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    small = d.where(F.length("text") <= chunk).mapInArrow(_short(path), "doc_id long, n_bytes long, n_tokens long")
    long = d.where(F.length("text") > chunk).withColumns(
        {"r1": F.xxhash64("text"), "r2": F.xxhash64(F.lit(7), "text"), "n_chars": F.length("text")})
    ids = saved(long.select("doc_id", "n_bytes", "r1", "r2"))
    texts = long.select("r1", "r2", "n_chars", "text")
    todo, known = texts.dropDuplicates(["r1", "r2"]), None
    while True:
        done = saved(_splice(todo, path, chunk, overlap))
        ready = done.where(F.col("n_tokens").isNotNull())
        known = ready if known is None else known.unionByName(ready)
        if done.where(F.col("n_tokens").isNull()).isEmpty():
            break
        todo = texts.join(done.where(F.col("n_tokens").isNull()).select("r1", "r2"), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
        overlap *= 2
        chunk = max(chunk, 2 * overlap)
    out = small.unionByName(ids.join(known, ["r1", "r2"]).select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
