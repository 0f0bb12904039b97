import hashlib
import random
import time

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from attesta.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  a b", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "a\n b  c\t\td", "it's  don't 'tis ' s",
    "\x1c a \x1f b　c   d", "1234 5٣٤ ½ a", "한국 \U0001f600\U0001f600 é",
    "\x00\x01 ​ x", "a" * 3000, " \x85 x\x85y", "Th*** the,%%% äöüß", "word " * 500,
]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def test_ids_equal_the_librarys(codec):
    want = Tokenizer.from_file(PATH)
    for text in TEXTS:
        ids = want.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == want.decode(ids, skip_special_tokens=False)


def test_long_words_take_no_square_of_time(codec):
    want, rng = Tokenizer.from_file(PATH), random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (255, 256, 257, 300, 1_000_000)] + ["ab" * 50_000, "é" * 700, "=" * 100_001]
    start = time.time()
    got = codec.ids(words)
    assert time.time() - start < 60
    assert got == [e.ids for e in want.encode_batch(words, add_special_tokens=False)]


def test_caches_may_overflow(codec, monkeypatch):
    want = Tokenizer.from_file(PATH)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    texts = [f"some words{i} <|endoftext|> and others" for i in range(600)]
    assert codec.ids(texts) == [e.ids for e in want.encode_batch(texts, add_special_tokens=False)]


def test_digests_and_round_trip(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, None, "x", 1), (0, "", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens long")
    want = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expect = []
    for i, t, *_ in rows:
        ids = want.encode(t or "", add_special_tokens=False).ids
        expect.append((i, len(ids), sha(",".join(map(str, ids))), sha(want.decode(ids, skip_special_tokens=False))))
    assert got == sorted(expect, key=str)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted((i, t or "") for i, t, *_ in rows if i is not None)


def test_empty_table(spark):
    docs = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert bpe.digests(docs, PATH).collect() == []
