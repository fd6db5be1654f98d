import random
import zlib

import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import encoding
from sparkloom.llm.common import fresh_path
from sparkloom.llm.encoding import library_encoder, separated, spaced
from sparkloom.llm.planes import op1_bit_planes, read_manifest, read_shards, shuffle, unshuffle, write_shards

SF = "/root/testdata/sf0.001"
AWKWARD = ["", " ", "a", "  two  spaces ", "Don't  STOP.\n\nnow , and then", "x" * 5000, "\x1c sep\x1f", "é ́e é", "tab\tand\r\nline\n", "<|endoftext|> <|startoftext|>", "日本語 テキスト。", "\0nul\0", "a.b,c\n d .e\n", "1 234 5.6", " em ", "emoji 🙂🙂", "it's we'll I'd", "İstanbul ẞ"]


def library(name):
    tokenizer = Tokenizer.from_file(P.path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
@settings(deadline=None, max_examples=50)
def test_planes_round_trip(ids, bits):
    assert unshuffle(shuffle(raw(ids), bits), len(ids)) == raw(ids)


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", separated), ("byte_bpe_50k.json", spaced)])
def test_cut_encoding_equals_the_library(name, cut, spark):
    texts = AWKWARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    plain = library(name)
    assert library_encoder(P.path(name), cut)(texts) == [raw(plain(t)) for t in texts]


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", separated), ("byte_bpe_50k.json", spaced)])
def test_names_of_special_tokens_have_their_ids(name, cut):
    texts = ["<|endoftext|>", "a<|endoftext|>b, c", "x <|endoftext|>\n<|endoftext|> y", "<|startoftext|> a", "<|ENDOFTEXT|>", "<| endoftext |>"]
    special = P.path(name), library_ids(name, "<|endoftext|>")
    assert len(special[1]) == 1 and library_encoder(special[0], cut)(texts) == [raw(library_ids(name, t)) for t in texts]


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", separated), ("byte_bpe_50k.json", spaced)])
def test_long_texts_and_small_tables(name, cut, monkeypatch):
    """Stretches of long texts join up, and pieces that share a slot or outgrow the memory of ids are still right."""
    monkeypatch.setattr(encoding, "STRETCH", 40)
    known = library_encoder(P.path(name), cut)
    small = encoding.Encoder(cut, known.many, known.whole, known.specials, slots=16, most_ids=50)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bc", " ", "  ", "\n", ",", "'s", "é", "漢", "12", "привет", "\u00a0"]) for _ in range(rng.randint(1, 400))) for _ in range(150)] + ["x" * 500, "日本" * 100]
    for lo in range(0, len(texts), 10):
        assert small(texts[lo : lo + 10]) == [raw(library_ids(name, t)) for t in texts[lo : lo + 10]]


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", separated), ("byte_bpe_50k.json", spaced)])
@given(texts=st.lists(st.text(st.sampled_from("aZé .,'\n\t1#\u0301 s\r\x0b\x1cλИ漢—\xa0\u2003×\u212aİ<|>")), max_size=4))
@settings(deadline=None, max_examples=600)
def test_cut_encoding_equals_the_library_on_any_text(name, cut, texts):
    assert library_encoder(P.path(name), cut)(texts) == [raw(library_ids(name, t)) for t in texts]


_known = {}


def library_ids(name, text):
    if name not in _known:
        _known[name] = library(name)
    return _known[name](text)


def test_op1_equals_the_library(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    start, expected = 0, []
    for r in rows:
        ids = [*library_ids("word_bpe_49k.json", r.text), 1]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(raw(ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in op1_bit_planes(spark, SF).collect()) == expected


@pytest.mark.parametrize("bits", [False, True])
def test_shards_with_awkward_rows(spark, bits):
    rows = [(3, None, 1), (1, "b", 1), (None, "n", 1), (1, "b", 2), (2, "", None), (4, "x y " * 40_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    folder = fresh_path(spark, "t")
    encode = lambda: lambda texts: [raw(map(ord, t or "")) for t in texts]
    write_shards(docs.repartition(3), folder, encode, 9, bits)
    got = read_shards(spark, folder, ids=True).collect()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, 1, 1, 2, 3, 4]
    assert [r.ids for r in ordered] == [raw([*map(ord, t), 9]) for t in ("n", "b", "b", "", "", "x y " * 40_000)]
    assert [r.start for r in ordered] == [0, 2, 4, 6, 7, 8] and all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert sum(e["n_docs"] for e in read_manifest(folder)) == 6


def test_no_documents(spark):
    folder = fresh_path(spark, "t")
    assert write_shards(spark.createDataFrame([], "doc_id long, text string"), folder, lambda: None, 1) == []
    assert read_shards(spark, folder).collect() == []
