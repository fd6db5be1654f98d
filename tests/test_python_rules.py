"""Nondeterminism in small sources: the lines found, and what is said of them."""

import pytest

from sparkloom.functions.python_rules import Source


def found(*lines):
    return sorted((f[0], f[4]) for f in Source("\n".join(lines) + "\n").nondeterminism())


def lines(*source):
    return [line for line, _ in found(*source)]


def test_clocks_and_entropy_by_any_name():
    got = found("from time import time_ns as ns", "import datetime, os as system", "import uuid", "ns()", "datetime.datetime.utcnow()", "system.urandom(4)", "uuid.uuid1()")
    assert [line for line, _ in got] == [4, 5, 6, 7]
    assert got[0][1].startswith("'time.time_ns()' reads the wall clock") and got[2][1].startswith("'os.urandom()' draws from OS entropy")


def test_random_is_excused_by_a_seed_of_its_own_kind():
    draws = ("import random, numpy", "random.gauss(0, 1)", "numpy.random.normal()", "numpy.random.PCG64()")
    assert lines(*draws) == [2, 3]
    assert lines(*draws, "random.seed(4)") == [3]
    assert lines(*draws, "numpy.random.seed(4)") == [2]
    assert lines(*draws, "random.seed(None)") == [2, 3, 5]
    assert lines("import numpy as n, random as r", "n.random.RandomState()", "n.random.RandomState(None)", "r.Random(0)", "n.random.default_rng(seed=1)") == [2, 3]


def test_hash_of_a_number_is_fixed():
    assert lines("hash(7)", "hash(True)", "hash('7')", "hash()", "hash(x)") == [3, 4, 5]


@pytest.mark.parametrize("use,count", [("list({})", 1), ("sorted({})", 0), ("max({})", 0), ("x in {}", 0), ("{} == x", 1), ("[y for y in {}]", 1), ("{{y for y in {}}}", 0), ("any(y for y in {})", 0), ("tuple(y for y in {})", 1), ("{{y: 1 for y in {}}}", 1), ("sum(len(z) for y in {} for z in y)", 0)])
@pytest.mark.parametrize("listing", ["os.listdir()", "glob.iglob('*')", "p.rglob('*')", "Path('.').iterdir()"])
def test_listings_matter_where_their_order_does(listing, use, count):
    assert len(lines("import os, glob", "from pathlib import Path", use.format(listing))) == count


def test_methods_of_modules_are_no_listings():
    assert lines("import walker, tree.deep", "walker.walk()", "tree.deep.glob()", "other.walk()", "f().walk()") == [4, 5]


@pytest.mark.parametrize("use,said", [("for y in {}: pass", "a for loop over a set"), ("[y for y in {}]", "a comprehension over a set"), ("f'{{{}}}'", "formatting a set"), ("print(*{})", "unpacking a set"), ("','.join({})", "'str.join()' of a set"), ("enumerate({})", "'enumerate()' of a set"), ("sorted({})", None), ("len({})", None), ("{{y for y in {}}}", None), ("x = {}", None), ("min(y for y in {})", None)])
@pytest.mark.parametrize("kind", ["{1, 2}", "frozenset(z)", "names", "names | z", "z - names", "names.union(z)", "{1}.difference(z)", "{k for k in z}"])
def test_sets_matter_where_their_order_does(kind, use, said):
    text = use.format(f"({kind})" if "f'" in use else kind)
    got = [message for line, message in found("names = set()", text)]
    assert [m.split(" depends on set iteration order")[0] for m in got] == ([said] if said else [])


@pytest.mark.parametrize("other", ["names = []", "def f(names): pass", "for names in z: pass", "names: list = sorted(z)"])
def test_a_name_given_anything_else_is_no_set(other):
    assert lines("names = {1}", other, "list(names)") == []


def test_deep_sources_do_not_recurse():
    assert lines("x = " + " + ".join(["1"] * 900), "list({1})") == [2]
