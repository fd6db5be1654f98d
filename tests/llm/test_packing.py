import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
from tokenizers import Tokenizer

from sparkloom.llm.packing import CAPACITY, op8_shortest_pack_first, pack, places, plan

SF = "/root/testdata/sf0.001"


def raw(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_plan_places_each_length_once_within_capacity():
    rng = random.Random(2)
    for _ in range(30):
        histogram = Counter(rng.randint(1, 64) for _ in range(rng.randint(0, 500)))
        patterns = plan(histogram, 64)
        placed = Counter()
        for lengths, count in patterns:
            assert sum(lengths) <= 64 and list(lengths) == sorted(lengths, reverse=True)
            for x in lengths:
                placed[x] += count
        assert placed == histogram
        for length, (first, start, at) in places(patterns).items():
            assert first[0] == 0 and len(first) == len(start) == len(at)


def test_longest_first_into_the_emptiest_pack():
    assert sorted(plan({6: 2, 5: 1, 3: 2, 1: 1}, 10)) == [((5, 3), 1), ((6, 1), 1), ((6, 3), 1)]


def check(rows, expected, capacity=CAPACITY):
    """rows as from pack(with_ids) or not; expected: doc_id -> list of id lists."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert set(by_doc) == set(expected)
    for doc_id, ids in expected.items():
        want = sorted((start, len(x[start : start + capacity]), zlib.crc32(raw(x[start : start + capacity])), len(x)) for x in ids for start in range(0, len(x), capacity))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id]) == want
    return len(by_sequence)


def test_op8_holds_each_id_once_with_little_padding(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = {r.doc_id: [[*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = check(op8_shortest_pack_first(spark, SF).collect(), expected)
    total = sum(len(x) for ids in expected.values() for x in ids)
    assert n <= total / CAPACITY * 1.02 + 1


def encode():
    return lambda texts: [raw(map(ord, t or "")) for t in texts]


def test_awkward_rows(spark):
    rows = [(1, None), (None, "abc"), (2, ""), (3, "x" * 50_000), (4, "ab"), (4, "ab"), (5, "y" * 16), (5, "y" * 15)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, rank int, length string")
    expected = defaultdict(list)
    for doc_id, text in rows:
        expected[doc_id].append([*map(ord, text or ""), 0])
    got = pack(docs.repartition(4), encode, 0, 16, with_ids=True)
    rows = got.collect()
    check(rows, expected, 16)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    without = pack(docs, encode, None, 16).collect()
    assert not [r for r in without if r.doc_id in (1, 2)]
    assert pack(docs.limit(0), encode, 0, 16).collect() == []
