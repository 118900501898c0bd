"""Token counts against the library on whole texts."""
import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moundflow.llm import token_count as T


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(T.default_path())


def want(tok, rows):
    return sorted(((i if i is not None else -1), len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > T.LIMIT)
                  for i, t in rows)


def got(df):
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in df.collect())


@given(st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "a", "'s", "'", "1", "é", "中", ".", "<|endoftext|>", "<|", " ", "\x1c", " ", "word"]), max_size=25))
@settings(max_examples=300, deadline=None)
def test_units_add_up(parts):
    enc = T.Encoder.of(T.default_path())
    text = "".join(parts)
    assert enc.counts([text]) == [len(enc.tok.encode(text, add_special_tokens=False).ids)]


@pytest.mark.parametrize("chunk,overlap", [(T.CHUNK, T.OVERLAP), (160, 60), (90, 40)])
def test_whole_texts(spark, tok, chunk, overlap):
    r = random.Random(2)
    rows = brute.awkward() + [(None, "null id"), (3, "a" * 900), (3, "a" * 900), (9, "\n" * 500), (10, "中文" * 400), (11, " ".join(["<|endoftext|>x"] * 60)),
                              (12, "".join(r.choice(["word", " ", "\n", "'ll", "<|endoftext|>", "  ", "é!", "12"]) for _ in range(900)))]
    assert got(T.count_tokens(brute.frame(spark, rows), chunk=chunk, overlap=overlap)) == want(tok, rows)


def test_empty_table(spark):
    assert T.count_tokens(brute.frame(spark, [(1, "a")]).where("doc_id < 0")).count() == 0


def test_overlap_is_checked(spark):
    with pytest.raises(ValueError):
        T.count_tokens(brute.frame(spark, [(1, "a")]), overlap=T.MARGIN)


def test_words_alone_align_at_once():
    """Spaced words without marks share boundaries: no overlap has to widen."""
    enc = T.Encoder.of(T.default_path())
    text = "schkeit " * 400
    a, b = enc.chunk(text[:1600]), enc.chunk(text[1400:])
    assert len({x for x in a[1] if 1400 < x < 1568} & {x + 1400 for x in b[1] if x < 168}) > 10


def test_huge_text_is_cut_in_time_linear_in_its_size():
    """64 MB against 16 MB: the cutting alone."""
    import time

    import pyarrow as pa

    from moundflow.llm import token_count as T
    def seconds(mb):
        text = "word another,\n" * (mb * (1 << 20) // 14)
        b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["r1", "r2", "text"])
        t, end, chunks = time.time(), 0, 0
        for c in T._chunks(T.CHUNK, T.OVERLAP)([b]):
            lo, part = c.column(3)[0].as_py(), c.column(5)[0].as_py()
            assert lo == max(0, end - T.OVERLAP) and (lo or chunks == 0)
            end, chunks = lo + len(part), chunks + 1
        assert end == len(text) and chunks == -(-len(text) // T.CHUNK)
        return time.time() - t
    small = seconds(16)
    assert seconds(64) < 12 * small + 1
