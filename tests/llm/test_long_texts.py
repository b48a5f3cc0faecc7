"""Texts of several MB, past the size of a scanned slice, against brute force."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken.load
import xxhash
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, fingerprints, packing, pii, secrets, sharding, simhash_dedup, toxicity
from tests.llm.test_matching_ops import spark_hash
from tests.llm.test_scoring_ops import check_packing, labelled

SECRET = 'password = "0641917ea4e9feb9cda83477b57ac2654884f485"'


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(7)
    words = [f"w{x}" for x in r.integers(0, 5000, 600_000)]
    return {1: " ".join(words) + f" mail bob@site.example.com {SECRET}", 2: "short one", 3: "é" * 1_500_000}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def majority(hashes):
    votes = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(int(2 * v > len(hashes)) << b for b, v in enumerate(votes))


def test_fingerprints_of_long_texts(docs, texts):
    got = {r.doc_id: r.fp[0] % (1 << 64) for r in simhash_dedup.near_duplicates(docs).collect()}
    own = {r.doc_id: int(r.fingerprint, 16) for r in fingerprints.fingerprint_edits(docs).collect()}
    for i, t in texts.items():
        words = t.lower().split()
        shingles = [" ".join(words[a : a + 4]) for a in range(max(1, len(words) - 3))]
        assert got[i] == majority([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles])
        assert own[i] == majority([spark_hash(a, b) for a, b in itertools.pairwise(words)] + [spark_hash(words[-1])])


def test_shards_of_long_texts(docs, texts):
    rows = {r.doc_id: r for r in sharding.shard_documents(docs).collect()}
    assert all((rows[i].size, rows[i].text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items())


def test_personal_data_and_secrets_at_the_end_of_a_long_text(spark, docs, texts):
    rows = {r.doc_id: r for r in pii.find_pii(docs, pii.Detector(None)).collect()}
    at = texts[1].index("bob@")
    assert rows[1].spans == f"email:{at}:{at + len('bob@site.example.com')}" and rows[2].spans == rows[3].spans == ""
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs, secrets.train_forest(secrets.labelled_findings(spark))).collect()}
    at = texts[1].index("0641917e")
    assert found == {1: f"{at}:{at + 40}", 2: "", 3: ""}


def test_toxic_word_at_the_end_of_a_long_text(spark, texts):
    docs, labels = labelled(spark)
    chain = toxicity.corpus_chain(docs, labels)
    calm = "w1 w2 w3 " * 400_000
    rows = spark.createDataFrame([(1, calm), (2, calm + "vilea vileb vilec")], "doc_id long, text string")
    p = {r.doc_id: r.p_toxic for r in toxicity.score_toxicity(rows, chain).collect()}
    assert p[2] > p[1]


def test_token_ids_of_long_texts(docs, texts):
    check_packing(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect(), list(texts.items()))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    some = {i: t[:400_000] for i, t in texts.items()}  # the library is slow on one long run of letters
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(path), special_tokens={})
    rows = byte_bpe.encode_documents(docs.withColumn("text", F.substring("text", 1, 400_000)), path, keep_ids=False).collect()
    for r in rows:
        ids = library.encode_ordinary(some[r.doc_id]) if r.doc_id != 3 else None
        if ids is not None:
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(some[r.doc_id].encode()).hexdigest()
