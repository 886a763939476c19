import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tessella.llm import bytebpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.load(PATH).merger.ranks, special_tokens={})


def test_code_points(library):
    bpe = bytebpe.load(PATH)
    points = [*range(0x3100), *random.Random(2).sample([c for c in range(0x3100, 0x110000) if not 0xD800 <= c < 0xE000], 20_000)]
    texts = [f"a{chr(c)}1 {chr(c)}" for c in points]
    assert bpe.encode(texts) == library.encode_ordinary_batch(texts)


def test_contractions_and_white_space(library):
    rng = random.Random(1)
    parts = ["'", "s", "re", "ve", "ll", "'re", "'s", "'ll", "d", "t", " ", "  ", "\n", "\t", "a", "é", "1", "!", " ", "　", "\0", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20_000)]
    texts += ["x" * 5000 + "!" * 3000 + " " * 2000, "ab'" * 500, "", " "]
    bpe = bytebpe.load(PATH)
    ids = bpe.encode(texts)
    assert ids == library.encode_ordinary_batch(texts)
    assert [bpe.decode(x).decode() for x in ids] == texts


def test_cache_of_two_generations(library):
    bpe = bytebpe.ByteBPE(bytebpe.load(PATH).merger.ranks, cache=3)
    text = "the quick brown fox jumps over the lazy dog and the quick cat " * 3
    assert bpe.encode([text]) == [library.encode_ordinary(text)]
    assert len(bpe.merger) <= 3


def test_frames(spark, library):
    rows = [(1, "it's  a\ntest", "x", 5), (None, None, None, None), (1, "it's  a\ntest", "x", 5), (2, "", "y", 6), (3, "long " * 50_000, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    out = bytebpe.decode(bytebpe.encode(docs, PATH), PATH, offsets="at").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted((r[0] or 0, r[1] or "") for r in rows)
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
        assert r["at"][-1] == len(r.decoded) and len(r["at"]) == len(r.ids) + 1
    assert bytebpe.encode(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in bytebpe.op2_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
