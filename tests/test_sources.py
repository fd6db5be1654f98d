"""Folders on disk: entries with links and oddities, digests, declared paths, lines of large files, and objects named by content."""

import datetime
import hashlib
import os
import random

import pytest

from sparkloom.operators import merkle
from sparkloom.operators.objects import ObjectStore
from sparkloom.sources import bundles

UTC = datetime.timezone.utc


def tree(root, files):
    for path, content in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)


def test_entries(spark, tmp_path):
    tree(tmp_path / "a", {"task.toml": b"x = 1", "d/e/f.txt": b"1\r\n", "__pycache__/x": b"", "né": b"nfd", "._junk": b""})
    os.symlink("d/e", tmp_path / "a/link")
    os.symlink("/nowhere", tmp_path / "a/gone")
    os.mkfifo(tmp_path / "a/pipe")
    (tmp_path / "b").mkdir()
    rows = bundles.bundle_entries(spark, [str(tmp_path / "a"), str(tmp_path / "b") + "/", str(tmp_path / "none")]).collect()
    got = {(os.path.basename(r.bundle), r.path): (r.content and bytes(r.content), r.link_target, r.problem and r.problem.split(" (")[0]) for r in rows}
    assert got == {("a", "task.toml"): (b"x = 1", None, None), ("a", "d/e/f.txt"): (b"1\r\n", None, None), ("a", "né"): (b"nfd", None, None), ("a", "link"): (None, "d/e", None), ("a", "gone"): (None, "/nowhere", None), ("a", "pipe"): (None, None, "unsupported file type"), ("none", "."): (None, None, "unreadable folder: No such file or directory")}
    entries = bundles.bundle_entries(spark, [str(tmp_path / "a")])
    digests = {r.path: (r.kind, r.size, r.sha256) for r in bundles.entry_digests(entries).collect()}
    assert digests["link"] == ("symlink", 3, hashlib.sha256(b"d/e").hexdigest()) and digests["d/e/f.txt"] == ("text", 2, hashlib.sha256(b"1\n").hexdigest())
    assert merkle.roots(bundles.entry_digests(entries), "t").count() == 1


def test_canonical_paths():
    assert bundles.canonical_path("a/né") == "a/né"
    for bad in ("/a", "", "a//b", "a/../b", "./a", "a/"):
        with pytest.raises(ValueError):
            bundles.canonical_path(bad)


def test_declared_paths_of_every_kind(spark):
    held = [("f.md", None, None), ("tests/x.py", None, None), ("in", "tests", None), ("out", "../x", None), ("abs", "/etc", None), ("deep/l", "../tests/x.py", None), ("locked", None, "unreadable file: no")]
    files = spark.createDataFrame([("b", *r) for r in held], "bundle string, path string, link_target string, problem string")
    asked = [("f.md", "file"), ("f.md", "dir"), ("tests", "dir"), ("tests", "file"), ("none", "file"), ("in", "dir"), ("in/x.py", "file"), ("in/y.py", "file"), ("out", "file"), ("out/a/b", "file"), ("abs", "dir"), ("deep/l", "file"), ("deep/l", "dir"), ("locked", "file"), (".", "dir"), ("deep", "dir")]
    declared = spark.createDataFrame([("b", f"loc{k}", p, kind) for k, (p, kind) in enumerate(asked)], "bundle string, loc string, path string, kind string")
    got = {int(r["loc"][3:]): r.code for r in bundles.missing_paths(declared, files).collect()}
    assert got == {1: "wrong_path_kind", 3: "wrong_path_kind", 4: "path_not_found", 7: "path_not_found", 8: "path_escapes_bundle", 9: "path_escapes_bundle", 10: "path_escapes_bundle", 12: "wrong_path_kind", 13: "path_unreadable"}


def test_unreadable_manifests(spark):
    files = spark.createDataFrame([("a", "task.toml", None, "unreadable file: no"), ("b", "task.toml", bytearray(b"x = 1"), None), ("c", "y", bytearray(b""), None), ("d", "task.toml", bytearray(b"\xff"), None)], "bundle string, path string, content binary, problem string")
    assert {r.bundle: r.issue for r in bundles.manifests(files).collect()} == {"a": "manifest_unreadable", "b": None, "c": "missing_manifest", "d": "manifest_encoding"}


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 20])
def test_lines_of_files_by_chunks(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    texts = {f"f{k}": "".join(rng.choice(["a", "bé", "\r", "\n", "\r\n", ""]) for _ in range(rng.randint(0, 60))).encode() for k in range(12)}
    texts |= {"empty": b"", "binary": b"a\0b\n", "bad": b"\xff\xfe\nx", "cr": b"\r\r\n\r", "open": b"x", "long": b"abc\r\n" * 3000 + b"\r" * 20, "wide": b"q" * 9000 + b"\0"}
    tree(tmp_path, texts)
    paths = spark.createDataFrame([("b", n, f"file://{tmp_path}/{n}") for n in [*texts, "none"]], "bundle string, file string, uri string")
    got = {}
    for r in sorted(bundles.text_lines(paths, chunk).collect()):
        got.setdefault(r.file, []).append((r.line, r.source))
    for name, raw in texts.items():
        lines = raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n").decode("utf-8", "replace").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert got.get(name, []) == ([] if name == "binary" else list(enumerate(lines, 1))), name


def test_objects(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/objects")
    key = lambda data: hashlib.sha256(data).hexdigest()
    assert store.objects().collect() == [] and store.size().first().objects == 0
    day = lambda d: datetime.datetime(2030, 1, d, tzinfo=UTC)
    data = [b"one", b"two!", b"three"]
    rows = lambda *parts: spark.createDataFrame([(bytearray(p) if p is not None else None,) for p in parts], "data binary")
    assert sorted((r.key, r.size, r.new) for r in store.put(rows(*data, b"one", None), day(1)).collect()) == sorted((key(d), len(d), True) for d in data)
    assert {r.key: r.new for r in store.put(rows(b"one", b"4444"), day(3)).collect()} == {key(b"one"): False, key(b"4444"): True}
    at = tmp_path / "objects" / key(b"two!")[:2] / key(b"two!")[2:]
    assert at.read_bytes() == b"two!" and at.stat().st_mode & 0o777 == 0o444
    keys = spark.createDataFrame([("sha256:" + key(b"one"),), (key(b"x"),), ("nonsense",)], "key string")
    assert [r.held for r in store.has(keys).orderBy("held").collect()] == [None, False, True]
    at.chmod(0o644)
    at.write_bytes(b"damaged")
    got = {r.key: (r.status, r.data and bytes(r.data)) for r in store.get(spark.createDataFrame([(key(d),) for d in (b"two!", b"three", b"x")], "key string"), day(2)).collect()}
    assert got == {key(b"two!"): ("corrupt", None), key(b"three"): ("found", b"three"), key(b"x"): ("not_found", None)} and not at.exists()
    (tmp_path / "objects" / "ab").mkdir(exist_ok=True)
    (tmp_path / "objects" / "ab" / ("tmp-" + "0" * 32)).write_bytes(b"left")
    used = {r.key: r.last_used for r in store.objects().collect()}
    assert used[key(b"three")] < used[key(b"one")] and len(used) == 3
    assert store.gc(7, now=datetime.datetime.now(UTC)) == {"removed": 1, "freed_bytes": 5, "kept": 2, "kept_bytes": 7, "stale": 0}
    assert store.gc(100, now=datetime.datetime.now(UTC) + datetime.timedelta(hours=2))["stale"] == 1
    assert {r.key for r in store.objects().collect()} == {key(b"one"), key(b"4444")}


def test_bundles_share_objects(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/objects")
    entries = [("a", "x", b"same"), ("a", "y", b"other"), ("b", "x", b"same")]
    rows = spark.createDataFrame([(b, p, "text", hashlib.sha256(c).hexdigest(), bytearray(c)) for b, p, c in entries], "bundle string, path string, kind string, sha256 string, content binary")
    roots = merkle.roots(rows, "t")
    assert sorted((r.bundle, r.objects, r.new_objects) for r in store.put_bundles(rows, roots, "t").collect()) == [("a", 3, 3), ("b", 2, 2)]
    again = store.put_bundles(rows, roots, "t").collect()
    assert {r.new_objects for r in again} == {0} and store.objects().count() == 4
    with pytest.raises(RuntimeError, match="a/y"):
        store.put_bundles(rows.withColumn("content", rows.content.substr(1, 4)), roots, "t")
