"""Byte-pair tokens beside the library that reads the same vocabulary."""

import base64
import random
import sys
import time

import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from shelfmine.functions import bpe
from shelfmine.operators import chunking
from shelfmine.plans.suites.parsing import VOCABULARY

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
ODD = [
    "", " ", "\n\n\n", "a", "don't they'll we're I've I'm he'd it's", "x   's  'll", "tab\t\tnew\n\n  line \n", "no break space　wide  ",
    "日本語のテキスト", "é" * 40, "é \U0001f600\U0001f469‍\U0001f680 flags", "\x00\x1c\x85 control", "1234567 ½ ²", "ab" * 3000,
    "<|endoftext|>", "٣٤٥ عربى", "ÀÈ ß ſ K",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pairs(spark):
    return bpe.BytePairs(spark, VOCABULARY)


@pytest.fixture(scope="module")
def texts(spark):
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)] + [(-100, None)], "doc_id bigint, text string")
    return spark.read.parquet(DOCUMENTS).select("doc_id", "text").unionByName(odd)


def test_ids_of_all_documents(pairs, texts, library):
    rows = texts.select("text", pairs.ids(F.col("text")).alias("ids"), pairs.count(F.col("text")).alias("n")).collect()
    assert len(rows) > 200
    for r in rows:
        want = None if r.text is None else library.encode_ordinary(r.text)
        assert r.ids == want and r.n == (None if want is None else len(want))


@pytest.mark.parametrize("size, overlap", [(500, 100), (7, 3)])
def test_windows_of_all_documents(pairs, texts, library, size, overlap):
    rows = texts.select("text", pairs.windows(F.col("text"), size, overlap).alias("w")).collect()
    for r in rows:
        if r.text is None:
            assert r.w is None
            continue
        ids = library.encode_ordinary(r.text)
        starts = range(0, len(ids), size - overlap)
        assert [w.ids for w in r.w] == [ids[s : s + size] for s in starts]
        assert [w.text for w in r.w] == [library.decode(ids[s : s + size]) for s in starts]
        assert [w.num_tokens for w in r.w] == [len(w.ids) for w in r.w] and [w.chunk for w in r.w] == list(range(1, len(r.w) + 1))
        for w in r.w:  # what is covered has the decoded text, up to characters cut at the borders
            inner = w.text.strip("�") if "�" not in r.text else w.text
            assert inner in r.text[w.start : w.end] and len(r.text[w.start : w.end].encode()) <= len(w.text.encode()) + 8


def test_offsets_of_tokens(pairs, texts, library):
    for r in texts.select("text", pairs.tokens(F.col("text")).alias("tokens")).where("text is not null").collect():
        data, at = r.text.encode(), 0
        for t in r.tokens:
            size = len(library.decode_single_token_bytes(t.id))
            low = len(data[:at].decode("utf-8", "ignore"))
            high = len(data[: at + size].decode("utf-8", "replace"))
            assert (t.start, t.end) == (low, high)
            at += size
        assert at == len(data)


def test_chunks_with_a_vocabulary(spark, pairs, library):
    text = "Front\nCHAPTER I.\n\n" + "The naïve 日本 rabbit hopped away. " * 60
    docs = spark.createDataFrame([("s", text), ("e", "")], "slug string, text string")
    rows = chunking.book_chunks(docs, max_tokens=50, overlap=10, tokenizer=pairs).orderBy("section", "chunk").collect()
    assert {r.section for r in rows} == {1, 2}
    assert all(r.num_tokens == len(library.encode_ordinary(r.text)) and r.num_chars == len(r.text) for r in rows)


def test_merging_is_near_linear():
    ranks = bpe.read_ranks(VOCABULARY)
    rng = random.Random(1)

    def seconds(n):
        word = "".join(rng.choice("abcdefgh") for _ in range(n)).encode()
        start = time.perf_counter()
        bpe.merged(word, ranks)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 20 * max(seconds(10_000), 0.01)


def test_file_that_is_no_byte_vocabulary(tmp_path):
    (tmp_path / "v").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="255 bytes"):
        bpe.read_ranks(str(tmp_path / "v"))


def test_memory_of_a_task_is_bounded(pairs, library):
    """A task remembers a bounded number of words, and of each no more than its ids' bytes."""
    encoder = bpe._Encoder(pairs.ranks.value)
    for start in range(0, 500_000, 50_000):
        words = pa.array([f"x{i}q".encode() for i in range(start, start + 50_000)], pa.binary())
        ids, counts = encoder.ids(words)
        assert len(encoder.known) <= bpe.REMEMBERED + 50_000
    assert sys.getsizeof(encoder.known[b"x499999q"]) < 33 + 4 * 8 + 1
    assert library.decode_bytes(ids[-counts[-1] :].tolist()) == b"x499999q"
    assert ids.dtype == "int32" and bpe.REMEMBERED + bpe.WORDS_AT_ONCE <= 300_000
