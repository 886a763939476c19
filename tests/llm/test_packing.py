import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tessella.llm import packing

PATH = P.path("byte_bpe_50k.json")


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(3)
    for _ in range(20):
        lengths = sorted((rng.randint(1, 50) for _ in range(300)), reverse=True)
        tree, left, most = packing.BestFit(50), [], 0
        for n in lengths:
            number, offset = tree.place(n)
            fits = [x for x in left if x >= n]
            if fits:
                assert 50 - offset == left[number] == min(fits)
            else:
                left.append(50)
                assert (number, offset) == (len(left) - 1, 0)
            left[number] -= n
        assert tree.made == len(left)


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids(text):
    t = TOKENIZER
    return [*t.encode(text, add_special_tokens=False).ids, 0]


def check(rows, texts):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for group in by.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for k, text in texts.items():
        whole, at = np.array(ids(text or ""), "<u4"), 0
        for i, r in enumerate(sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            assert r.length == 2048 or i == 0
            at += r.length
        assert at == whole.size
    return len(by)


def test_edges(spark):
    texts = {1: "a b's  c\n" * 4000, 2: None, 3: "", 4: " " * 5000 + "x" * 9000, 5: "word " * 10, 6: "word " * 10, 7: "<|endoftext|>", None: "no id"}
    docs = spark.createDataFrame([(k, v, 1, 2) for k, v in texts.items()], "doc_id long, text string, length int, offset int")
    check(packing.packed_documents(docs).collect(), texts)
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = packing.op3_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    made = check(rows, {r.doc_id: r.text for r in docs})
    least = -(-sum(r.length for r in rows) // 2048)
    assert made <= least + 3
