"""Record files: checksums against a plain version, ids against the library, round trips."""
import glob
import random
import struct
import zlib

import numpy as np
import pytest

from moundflow.llm import queries, records

SCHEMA = "doc_id long, text string, r1 long, `a.b` string, ids string"


def plain_crc32c(b):
    c = 0xFFFFFFFF
    for x in b:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def plain_mask(c):
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksum():
    assert records.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0, 9]))[0] == 0xE3069283
    rnd = random.Random(1)
    parts = [rnd.randbytes(n) for n in [0, 1, 2, 3, 4, 5, 0, 255, 256, 257, 300, 70_000, 8, 0]]
    off = np.cumsum([0, *map(len, parts)])
    got = records.crc32c(np.frombuffer(b"".join(parts), np.uint8), off)
    assert got.tolist() == [plain_crc32c(p) for p in parts]


def awkward():
    rnd = random.Random(3)
    texts = ["Hello world", None, "", " ", "\n\n", "don't STOP 's 've", "á e ́x", "tab\tand\x1cfile sep", "no break em", "\x85next", "<|endoftext|> in<|startoftext|>side",
             "ΣΑΣ ΟΔΟΣ", "İstanbul ǅ", "x" * 3000, "word " * 5000, "한국어 日本語 😀 1234567", "Same", "Same"]
    texts += ["".join(rnd.choice("ab 'sé\n\t1.!ΑΣ😀") for _ in range(rnd.randrange(80))) for _ in range(150)]
    rows = [(i * 7 % 400, t, 1, "x", "y") for i, t in enumerate(texts)]
    return rows + [(None, "no id", 1, "x", "y"), (5, "again", 1, "x", "y"), (5, "again", 1, "x", "y"), (2**60 + 1, "big", 1, "x", "y")]


def library(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(records.default_path())
    return [[*e.ids, 2] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("file_bytes", [2_000, 1 << 27])
def test_round_trip(spark, tmp_path, file_bytes, monkeypatch):
    monkeypatch.setattr(records, "LEAST_BYTES", 1 << 30)
    rows = awkward()
    path = records.write_records(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"), file_bytes=file_bytes)
    got = records.read_records(spark, path).orderBy("start").collect()
    want = library([r[1] for r in rows])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, bytes(r.ids)) for r in got) == \
        sorted((r[0] is not None, r[0] or 0, len(w), struct.pack(f"<{len(w)}I", *w)) for r, w in zip(rows, want))
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert ids == sorted(ids)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    files = glob.glob(f"{path}/*.rec")
    assert len(files) > 3 if file_bytes == 2_000 else len(files) == 1
    # the files themselves, read without the library code
    n = 0
    for f in files:
        b = open(f, "rb").read()
        while b:
            size, head = struct.unpack("<QI", b[:12])
            data, (tail,) = b[12:12 + size], struct.unpack("<I", b[12 + size:16 + size])
            assert head == plain_mask(plain_crc32c(b[:8])) and tail == plain_mask(plain_crc32c(data))
            n, b = n + size // 2, b[16 + size:]
    assert n == sum(map(len, want))


def test_shuffled_reads(spark, tmp_path):
    path = records.write_records(spark.createDataFrame(awkward(), SCHEMA), str(tmp_path / "out"), file_bytes=2_000)

    def order(seed):
        return [(r.start, r.n_tokens, bytes(r.ids)) for r in records.read_shuffled(spark, path, seed).collect()]
    one = order(1)
    assert one == order(1) and one != order(2)
    assert sorted(one) == sorted((r.start, r.n_tokens, bytes(r.ids)) for r in records.read_records(spark, path).collect())
    starts = [x[0] for x in one]
    assert starts != sorted(starts)


def test_damage_and_orphans(spark, tmp_path):
    path = records.write_records(spark.createDataFrame(awkward(), SCHEMA), str(tmp_path / "out"))
    open(f"{path}/part-of-a-lost-attempt.rec", "wb").write(b"xx")
    n = records.read_records(spark, path).count()
    assert n == len(awkward())
    name = next(f for f in sorted(glob.glob(f"{path}/part-*.rec")) if "lost" not in f)
    b = bytearray(open(name, "rb").read())
    b[40] ^= 1
    open(name, "wb").write(bytes(b))
    with pytest.raises(Exception, match="damaged|does not fit"):
        records.read_records(spark, path).count()


def test_empty(spark, tmp_path):
    path = records.write_records(spark.createDataFrame([], SCHEMA), str(tmp_path / "out"))
    assert records.read_records(spark, path).count() == 0 == records.read_shuffled(spark, path, 1).count()


def test_other_tokenizer_encodes_whole_texts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    p = str(public_tokenizers.path("byte_bpe_50k.json"))
    assert records.drops_space(records.default_path()) and not records.drops_space(p)
    texts = ["a  b\n\n c", " lead", "", "x\ty"]
    path = records.write_records(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), str(tmp_path / "o"), p, None)
    got = [list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in records.read_records(spark, path).orderBy("doc_id").collect()]
    tok = Tokenizer.from_file(p)
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for d, ids in zip(docs, library([d.text for d in docs])):
        want.append((d.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op13_token_records(spark, small_dir).collect()) == want
