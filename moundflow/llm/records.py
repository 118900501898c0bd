"""Token ids as files of length-delimited binary records with a separate offset
index.

A record is its length (8 bytes), the masked CRC-32C of these 8 bytes, the ids
and their masked CRC-32C, all little-endian: the common framing of training
records.  Beside each ``.rec`` file stands a ``.idx`` file with four 8-byte
integers a record: document id, whether it has one, offset in the file, tokens.
Tasks write both under a name of their own; only files of attempts that ended
well are in the manifest, a Parquet table written last, so lost executors and
repeated attempts leave nothing that a reader sees."""
from __future__ import annotations

import os
import sys
import types
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundflow.llm.base import id_text, record, row_key, text_slices
from moundflow.session import ensure_checkpoint_dir, task_slots

#: Text bytes that go to one file, and the fewest where more files would only be more overhead.
FILE_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
#: Bytes of records that a reader checks at once, and files a task of a shuffled read keeps open.
READ_BYTES, OPEN_FILES = 4 << 20, 64
#: Text bytes encoded at once.
SLICE = 1 << 20
#: Parts whose ids a worker keeps (a memory bound; texts are encoded whole).
MEMO = 1_400_000
END_ID = 2


# --- CRC-32C over many byte strings at once ---------------------------------------------

class Zeros:
    """Appending zero bytes to a message is linear in its checksum.  ``by(j)``
    gives two tables of 65,536 entries that append 2**j bytes to many at once."""

    tables: list[tuple[np.ndarray, np.ndarray]] = []

    @classmethod
    def by(cls, j: int) -> tuple[np.ndarray, np.ndarray]:
        if not cls.tables:
            c = np.arange(256, dtype=np.uint32)
            for _ in range(8):
                c = np.where(c & 1, (c >> 1) ^ np.uint32(0x82F63B78), c >> 1)
            low = np.arange(65536, dtype=np.uint32)
            high = low << np.uint32(16)
            cls.tables.append(tuple(c[x & 255] ^ (x >> np.uint32(8)) for x in (low, high)))
        while len(cls.tables) <= j:
            one = cls.tables[-1]
            cls.tables.append(tuple(cls.apply(one, x) for x in one))
        return cls.tables[j]

    @staticmethod
    def apply(table: tuple[np.ndarray, np.ndarray], c: np.ndarray) -> np.ndarray:
        return table[0][c & np.uint32(0xFFFF)] ^ table[1][c >> np.uint32(16)]


def _padded(values: np.ndarray, counts: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Each run of values with zeros before it, up to a multiple of ``unit``; and these multiples."""
    groups = -(-counts // unit)
    out = np.zeros(int(groups.sum()) * unit, values.dtype)
    shift = np.cumsum(groups * unit) - np.cumsum(counts)
    out[np.arange(len(values)) + np.repeat(shift, counts)] = values
    return out, groups


def crc32c(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """CRC-32C of each byte string.  Checksums of words are folded 64 at a time,
    in lockstep over all strings; zeros before a message do not change its sum."""
    size = np.diff(off)
    out, counts = _padded(data[off[0]:off[-1]], size, 4)
    values, level = Zeros.apply(Zeros.by(2), out.view("<u4")), 2
    while counts.size and counts.max() > 1:
        values, counts = _padded(values, counts, 64)
        lanes, table = np.ascontiguousarray(values.reshape(-1, 64).T), Zeros.by(level)
        values = lanes[0]
        for lane in lanes[1:]:
            values = Zeros.apply(table, values) ^ lane
        level += 6
    sums = np.zeros(len(size), np.uint32)
    sums[size > 0] = values
    start = np.full(len(size), 0xFFFFFFFF, np.uint32)       # the start value moves past all bytes
    for j in range(int(size.max(initial=0)).bit_length()):
        start = np.where(size >> j & 1, Zeros.apply(Zeros.by(j), start), start)
    return sums ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


# --- frames ---------------------------------------------------------------------------------

def _bytes(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.uint8)


def frames(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as framed records, and where each begins (and all end)."""
    size = np.diff(off)
    head = _bytes(size.astype("<u8"))
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 16, out=at[1:])
    out = np.empty(int(at[-1]), np.uint8)
    out[at[:-1, None] + np.arange(8)] = head.reshape(-1, 8)
    out[at[:-1, None] + np.arange(8, 12)] = _bytes(masked(crc32c(head, np.arange(len(size) + 1) * 8)).astype("<u4")).reshape(-1, 4)
    out[np.arange(len(data)) + np.repeat(at[:-1] + 12 - off[:-1], size)] = data
    out[at[1:, None] - 4 + np.arange(4)] = _bytes(masked(crc32c(data, off)).astype("<u4")).reshape(-1, 4)
    return out, at


def unframe(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings of framed records that begin at ``at`` (which ends with the
    buffer's end); a length or a checksum that does not hold raises."""
    size = at[1:] - at[:-1] - 16
    if (size < 0).any():
        raise ValueError("record index does not fit its file")
    head = buf[at[:-1, None] + np.arange(12)]
    if (np.ascontiguousarray(head[:, :8]).view("<u8")[:, 0] != size).any():
        raise ValueError("record length does not fit its index")
    sums = np.ascontiguousarray(head[:, 8:]).view("<u4")[:, 0]
    if (sums != masked(crc32c(_bytes(head[:, :8]).reshape(-1), np.arange(len(size) + 1) * 8))).any():
        raise ValueError("record length is damaged")
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    data = buf[np.arange(off[-1]) + np.repeat(at[:-1] + 12 - off[:-1], size)]
    sums = np.ascontiguousarray(buf[at[1:, None] - 4 + np.arange(4)]).view("<u4")[:, 0]
    if (sums != masked(crc32c(data, off))).any():
        raise ValueError("record data are damaged")
    return data, off


# --- ids -------------------------------------------------------------------------------------

def default_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


#: Marks that end a word: after a letter or digit they are words of their own.
TAILS = ".,;:!?#$%&*"


class Ids:
    """Ids of whole texts as little-endian bytes.

    A tokenizer that drops white space and looks at nothing beyond it gives the
    ids of the parts between spaces and line ends, one after the other; these
    are remembered (tests hold this against the library on whole texts).  A new
    part is a word and the marks after it; words of letters alone are one word
    to the tokenizer too, so many are encoded as one text and cut where its
    word ends are.  Other tokenizers encode whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.dtype = id_type(self.tok.get_vocab_size(with_added_tokens=True))
        self.by_parts = drops_space(path)
        self.last = word_ends(path, self.tok.get_vocab(with_added_tokens=True))
        self.memo: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Ids":
        """One for each worker process and file: what it remembers serves later tasks."""
        home = sys.modules.setdefault("_moundflow_ids", types.ModuleType("_moundflow_ids"))
        if path not in home.__dict__:
            setattr(home, path, cls(path))
        return getattr(home, path)

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for i in range(0, len(texts), 4096)
                for e in self.tok.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, 200 to a text."""
        if self.last is None:
            return self.library(words)
        out, width = [], np.dtype(self.dtype).itemsize
        groups = [words[i:i + 200] for i in range(0, len(words), 200)]
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * width).tolist()
            if len(ends) != len(group):         # some word is several to the tokenizer, and none is nothing
                out += self.library(group)
                continue
            data = ids.tobytes()
            out += [data[a:z] for a, z in zip([0, *ends], ends)]
        return out

    def learn(self, parts: list[str]) -> None:
        """A part is a word, in small letters where that is plain, and its tail."""
        memo = self.memo
        cores = [x.rstrip(TAILS) for x in parts]
        words = [c.lower() if c.isascii() else c for c in cores]
        plain = [w.isalpha() for w in words]
        new = list({w for w, ok in zip(words, plain) if ok}.difference(memo))
        whole = [x for x, ok in zip(parts, plain) if not ok]
        whole += {x[len(c):] for x, c, ok in zip(parts, cores, plain) if ok and len(x) > len(c)}.difference(memo)
        memo.update(zip(new, self.words(new)))
        memo.update(zip(whole, self.library(whole)))
        memo[""] = b""
        memo.update([(x, memo[w] + memo[x[len(c):]]) for x, c, w, ok in zip(parts, cores, words, plain) if ok])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_parts:
            return self.library(texts)
        if len(self.memo) > MEMO:
            self.memo.clear()
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(list(set().union(*parts).difference(self.memo)))
        return [b"".join(map(self.memo.__getitem__, x)) for x in parts]


def word_ends(path: str, vocabulary: dict[str, int]) -> np.ndarray | None:
    """Which ids end a word, for a vocabulary that marks them."""
    import json
    with open(path, encoding="utf-8") as f:
        suffix = (json.load(f).get("model") or {}).get("end_of_word_suffix")
    if not suffix:
        return None
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
    return out


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def drops_space(path: str) -> bool:
    """Whether a tokenizer file drops all white space before it looks for words,
    so that no id depends on what stands beyond a space."""
    import json
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    norm = j.get("normalizer") or {}
    pre = j.get("pre_tokenizer") or {}
    pre = (pre.get("pretokenizers") or [pre])[0]
    words = str((pre.get("pattern") or {}).get("Regex") or " ")
    return (pre.get("type") == "Split" and pre.get("behavior") == "Removed" and pre.get("invert") is True
            and " " not in words and "\\s" not in words.replace("[^\\s", "") and "." not in words
            and all(n.get("type") in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace") and (n.get("type") != "Replace" or n.get("pattern") == {"Regex": "\\s+"})
                    for n in norm.get("normalizers") or ([norm] if norm else []))
            and not j.get("post_processor") and not any(any(c.isspace() for c in a["content"]) for a in j.get("added_tokens", [])))


# --- files -------------------------------------------------------------------------------------

def store(path: str):
    """The file system of a folder that executors share, and the folder's name there."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


MANIFEST = "file string, has boolean, doc_id long, r1 long, r2 long, records long, tokens long, width int"


def _write(path: str, tokenizer: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.of(tokenizer)
        end = b"" if end_id is None else np.array([end_id], ids.dtype).tobytes()
        width, name, out, first, at, n, tokens = np.dtype(ids.dtype).itemsize, f"part-{uuid.uuid4().hex}", None, None, 0, 0, 0
        for part, _, _ in text_slices(batches, limit=SLICE):
            doc, r1, r2, texts = (c.to_pylist() for c in part.columns)
            if out is None:
                fs, top = store(path)
                fs.create_dir(top, recursive=True)
                out, index = fs.open_output_stream(f"{top}/{name}.rec"), fs.open_output_stream(f"{top}/{name}.idx")
                first = (doc[0] is not None, doc[0], r1[0], r2[0])
            coded = [x + end for x in ids.encode(texts)]
            off = np.cumsum([0, *map(len, coded)])
            buf, begin = frames(np.frombuffer(b"".join(coded), np.uint8), off)
            counts = np.diff(off) // width
            rows = np.stack([np.array([d or 0 for d in doc], np.int64), np.array([d is not None for d in doc], np.int64), begin[:-1] + at, counts], 1)
            out.write(buf.tobytes())
            index.write(rows.astype("<i8").tobytes())
            at, n, tokens = at + len(buf), n + len(doc), tokens + int(counts.sum())
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "has", "doc_id", "r1", "r2", "records", "tokens", "width"), (name, *first, n, tokens, width)))],
                                             schema=pa.schema([("file", pa.string()), ("has", pa.bool_()), *[(c, pa.int64()) for c in ("doc_id", "r1", "r2", "records", "tokens")], ("width", pa.int32())]))
    return run


def write_records(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int | None = END_ID,
                  file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write every text's ids (``end_id`` after each) to ``path`` in ascending
    order of document id; returns the path, by default a new one in the shared
    folder.  Null ids come first; rows of one id go by a hash of their text, and
    are dealt to several files where one id has very many.  A null or empty text
    is a record of the end id alone.  Other columns are left out.  An empty table
    gives an empty manifest."""
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    d = id_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    files = max(-(-total // file_bytes), min(task_slots(spark, 2), -(-total // LEAST_BYTES)), 1)
    keyed = d.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    dealt = keyed.repartitionByRange(files, "doc_id", "r1", "r2").sortWithinPartitions("doc_id", "r1", "r2")
    dealt.mapInArrow(_write(path, tokenizer or default_path(), end_id), MANIFEST).write.parquet(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files in order: ``place``, and ``start``, the tokens before each.  One
    row a file, so this sum over all of them is small."""
    m = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    w = Window.orderBy("has", "doc_id", "r1", "r2", "file")
    return m.select("file", "width", "records", "tokens", F.row_number().over(w).cast("long").alias("place"),
                    F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))


RECORD = "doc_id long, start long, n_tokens long, ids binary"
_RECORD = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _entries(fs, top: str, name: str) -> np.ndarray:
    with fs.open_input_file(f"{top}/{name}.idx") as f:
        return np.frombuffer(f.readall(), "<i8").reshape(-1, 4)


def _out(entries: np.ndarray, start: np.ndarray, data: np.ndarray, off: np.ndarray, width: int) -> pa.RecordBatch:
    wide = _bytes(data.view(f"<u{width}").astype("<u4"))
    off = (off // width * 4).astype(np.int32)
    ids = pa.Array.from_buffers(pa.binary(), len(entries), [None, pa.py_buffer(off), pa.py_buffer(wide)])
    return record(_RECORD, pa.array(entries[:, 0], pa.int64(), mask=entries[:, 1] == 0), start, entries[:, 3], ids)


def _ends(entries: np.ndarray, width: int) -> np.ndarray:
    return entries[:, 2] + 16 + entries[:, 3] * width


def _read(path: str):
    def run(batches):
        fs, top = store(path)
        for b in batches:
            for name, width, begin in zip(*[c.to_pylist() for c in b.columns]):
                e = _entries(fs, top, name)
                ends, before = _ends(e, width), np.cumsum(e[:, 3]) - e[:, 3] + begin
                with fs.open_input_file(f"{top}/{name}.rec") as f:
                    if f.size() != (ends[-1] if len(e) else 0):
                        raise ValueError(f"{name}: the index does not fit the file")
                    i = 0
                    while i < len(e):
                        j = max(i + 1, int(np.searchsorted(ends, e[i, 2] + READ_BYTES, "right")))
                        buf = np.frombuffer(f.read_at(int(ends[j - 1] - e[i, 2]), int(e[i, 2])), np.uint8)
                        data, off = unframe(buf, np.append(e[i:j, 2], ends[j - 1]) - e[i, 2])
                        yield _out(e[i:j], before[i:j], data, off, width)
                        i = j
    return run


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all records before it), n_tokens, ids (as
    little-endian unsigned 32-bit integers) of every record, lengths and
    checksums checked.  Files are read in parallel, each in blocks."""
    files = manifest(spark, path).select("file", "width", "start")
    return files.repartition(task_slots(spark), "file").mapInArrow(_read(path), RECORD)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index as a table: file, width, n (place in the file), doc_id, offset, start, n_tokens."""
    files = manifest(spark, path).select("file", "width", "start")

    def run(batches):
        fs, top = store(path)
        for b in batches:
            for name, width, begin in zip(*[c.to_pylist() for c in b.columns]):
                e = _entries(fs, top, name)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(e), pa.string()), pa.array([width] * len(e), pa.int32()), pa.array(np.arange(len(e))),
                     pa.array(e[:, 0], pa.int64(), mask=e[:, 1] == 0), pa.array(e[:, 2], pa.int64()),
                     pa.array(np.cumsum(e[:, 3]) - e[:, 3] + begin), pa.array(e[:, 3], pa.int64())],
                    names=["file", "width", "n", "doc_id", "offset", "start", "n_tokens"])
    return files.repartition(task_slots(spark), "file").mapInArrow(run, "file string, width int, n long, doc_id long, offset long, start long, n_tokens long")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in a random order that the seed fixes: only index rows are
    shuffled, each task then reads its records where they stand.  The order is
    that of the partitions and of the rows in them, as after a global sort."""
    # by the place of a record, not its file, whose name another run would not repeat
    d = index(spark, path).withColumn("key", F.xxhash64(F.lit(seed), "start"))
    order = d.repartitionByRange("key", "start").sortWithinPartitions("key", "start")

    def run(batches):
        fs, top = store(path)
        files: OrderedDict = OrderedDict()
        for b in batches:
            rows = list(zip(*[c.to_pylist() for c in b.columns]))
            for lo in range(0, len(rows), 256):
                bufs, some = [], rows[lo:lo + 256]
                for name, width, doc, offset, start, n in some:
                    f = files.pop(name, None) or fs.open_input_file(f"{top}/{name}.rec")
                    files[name] = f
                    if len(files) > OPEN_FILES:
                        files.popitem(last=False)[1].close()
                    bufs.append(f.read_at(16 + n * width, offset))
                width = some[0][1]
                data, off = unframe(np.frombuffer(b"".join(bufs), np.uint8), np.cumsum([0, *map(len, bufs)]))
                e = np.array([[doc or 0, doc is not None, offset, n] for _, _, doc, offset, _, n in some], np.int64)
                yield _out(e, np.array([r[4] for r in some], np.int64), data, off, width)
        for f in files.values():
            f.close()
    return order.select("file", "width", "doc_id", "offset", "start", "n_tokens").mapInArrow(run, RECORD)


def digest(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of records that were read back."""
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
