import base64
import hashlib
import random
import time
from array import array

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken

from sparkloom.llm.bpe import Codec, Merger, encode_documents, op4_rank_queue_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabet = "aab  .\n\té漢🙂1'sß"
    out = ["", " ", "  ", "a  b", " x ", "ab" * 3000, "z" * 9999, "é" * 2000, "<|endoftext|>", "a b", "\n\n \n"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]


def test_encoding_equals_tiktoken(known):
    codec = Codec(PATH, P.PATTERN)
    got = codec.encode(texts())
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [known.encode_ordinary(t) for t in texts()]
    assert [codec.decode(g).decode() for g in got] == texts()


def test_long_pre_token_takes_about_linear_time():
    merger = Codec(PATH, P.PATTERN)
    rng = random.Random(1)
    took = []
    for n in (20_000, 160_000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode()
        began = time.process_time()
        ids = Merger(merger.ranks)(word)
        took.append(time.process_time() - began)
        assert merger.decode(array("I", ids).tobytes()) == word
    assert took[1] < 25 * took[0]


def test_equal_ranks_merge_from_the_left():
    ranks = {bytes([k]): k for k in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258}
    assert Merger(ranks)(b"aaaaa") == [256, 257]
    assert Merger(ranks)(b"aaab") == [257, 98]


def test_op4_equals_tiktoken(spark, known):
    expected = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = known.encode_ordinary(r.text or "")
        expected[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in op4_rank_queue_bpe(spark, SF).collect()} == expected


def test_nulls_repeats_and_other_columns(spark):
    docs = spark.createDataFrame([(None, None, 1, "p"), (1, "a b", None, "q"), (1, "a b", 2, "q"), (2, "w" * 300_000, 3, "r")], "doc_id long, text string, ids int, rank string")
    got = encode_documents(docs, PATH, P.PATTERN)
    assert got.columns == ["doc_id", "rank", "ids"]
    rows = got.collect()
    assert len(rows) == 4 and next(r.ids for r in rows if r.doc_id is None) == b"" and len({bytes(r.ids) for r in rows if r.doc_id == 1}) == 1
    assert encode_documents(docs.limit(0), PATH, P.PATTERN).collect() == []
