import hashlib

import pytest
from pyspark.sql import types as T

from ridgeline.llm import bpe, token_counts, vocab

TEXTS = [
    None, "", " ", "the cat's 12 mats.\n\tx", "Éçan ΑΣ ΣΑΣ İstanbul ﬁ é ́x", "a\x85b\xa0c\x1cd e", "<|startoftext|> a<|endoftext|>b <|x|> <|STARTOFTEXT|>",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000 + "!?" * 400 + "ab" * 3000, "日本語テキスト 🙂🙂 ½ ٣", "don't I'LL we've '''s", "the cat's 12 mats.\n\tx", "\0\x07 ​﻿",
]


@pytest.fixture(scope="module")
def expected():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab.default_path())
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.LongType())])
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(TEXTS)], schema)


def test_encode_and_decode_match_the_library(docs, expected):
    t, ids = expected
    found = bpe.encode(docs)
    assert {r.doc_id: list(r.ids) for r in found.collect()} == dict(enumerate(ids))
    assert {r.doc_id: r.text for r in bpe.decode(found).collect()} == {i: t.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_round_trip_digests(spark, docs, expected, tmp_path):
    t, ids = expected
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.query(spark, str(tmp_path)).collect():
        want = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(" ".join(map(str, want))), sha(t.decode(want, skip_special_tokens=False)))


def test_counts_match_the_library(spark, docs, expected, tmp_path):
    docs.union(docs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = token_counts.query(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        n = len(expected[1][r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((TEXTS[r.doc_id] or "").encode()), n, n > 2048)


def test_empty_table(docs):
    none = docs.where("doc_id < 0")
    assert bpe.encode(none).count() == bpe.round_trip(none).count() == token_counts.count_tokens(none).count() == 0


def test_small_caches_give_the_same(expected, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNKS", 2)
    monkeypatch.setattr(token_counts, "WORDS", 2)
    c = token_counts.Counter(vocab.default_path())
    for _ in range(3):
        assert c.count([(t or "").encode() for t in TEXTS]) == [len(x) for x in expected[1]]
