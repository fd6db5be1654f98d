import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import code_tokens, minhash, text


def test_optimal_bands():
    assert [minhash.optimal_bands(t) for t in (0.3, 0.5, 0.7, 0.9)] == [(37, 3), (25, 5), (14, 9), (5, 25)]
    with pytest.raises(ValueError):
        minhash.optimal_bands(1.0)


def test_shingle_hashes_and_signature():
    shingles = ["sort the rows", "the rows then", "rows then print"]
    hashes = [minhash.shingle_hash(s) for s in shingles]
    assert hashes == [1980699372142197387, 210494305681727245, 1896143451321647597]
    sig = minhash.signature(np.array(hashes, np.uint64)).tolist()
    assert sig[:3] == [671648852042824370, 264294885024444535, 667658549242744191] and sig[-1] == 177924941015051080
    assert minhash.band_key(0, sig[:5]) == "0:3e5a4262a48094ef"
    assert set(minhash.signature(np.zeros(0, np.uint64)).tolist()) == {minhash.MODULUS}


def test_modular_product():
    rng = np.random.default_rng(0)
    a, x = rng.integers(0, minhash.MODULUS, (2, 500), dtype=np.uint64)
    assert minhash._times(a, x).tolist() == [int(p) * int(q) % minhash.MODULUS for p, q in zip(a, x)]


def test_code_tokens_ignore_names_comments_and_layout():
    one = 'def f(a, b):\n    """doc"""\n    total = a + b  # sum\n    return total\n'
    two = "def g(x, y):\n\n    z = x + \\\n        y\n    return z\n"
    assert code_tokens.code_tokens(one) == code_tokens.code_tokens(two)
    assert code_tokens.code_tokens("f(0XFF, 'a')") == ["ID0", "(", "0xff", ",", "STR", ")"]
    assert code_tokens.code_tokens("foo(bar, # open\n") == ["ID0", "(", "ID1", ","]


def test_entropy_sizes_and_ids(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("abcd",), ("aabb",), ("0123456789abcdef",)], "v string")
    assert [round(r[0], 9) for r in rows.select(text.entropy(F.col("v"))).collect()] == [0, 0, 1, 2, 1, 4]
    one = spark.createDataFrame([("My_Task.Name-1", "1.5M", "2GiB")], "a string, b string, c string")
    got = one.select(text.fold_id(F.col("a")), text.parse_size(F.col("b")), text.parse_size(F.col("c")), text.human_size(F.lit(1536)), text.redacted(F.lit("abcdefgh"), 4)).first()
    assert tuple(got) == ("mytaskname1", None, 2 << 30, "1.5 KiB", "abcd[redacted, 8 chars]")
    assert text.location(["a", "b", 2, "c"]) == "a.b[2].c"


def test_lines(spark):
    rows = spark.createDataFrame([("a\r\nb\rc\n",), ("x",)], "t string").select(text.split_lines(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [["a", "b", "c"], ["x"]]
