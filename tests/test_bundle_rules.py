import textwrap

import pytest

from sparkloom.functions import dockerfile, manifest, python_rules
from sparkloom.operators import bundle_rules, lint
from sparkloom.sources import bundles

MINIMAL = {"schema_version": 1, "task": {"id": "my-task", "version": "1.0.0", "title": " A title ", "category": "math"}}
PIN = "python:3.12@sha256:" + "a" * 64


def issues(**changes):
    data = {**MINIMAL, **changes}
    return [(manifest.place(p), c) for p, c, _ in manifest.validate(data)[1]]


def task(**changes):
    return issues(task={**MINIMAL["task"], **changes})


def test_minimal_manifest_is_canonical():
    values, found = manifest.validate(MINIMAL)
    assert found == []
    assert manifest.canonical(values) == '{"schema_version":1,"task":{"category":"math","id":"my-task","title":"A title","version":"1.0.0"}}'
    assert [p for _, p, _ in manifest.declared_paths(values)] == ["instruction.md", "environment/Dockerfile", "verifier/Dockerfile", "solution", "solution/solve.sh", "tests"]


def test_defaults_metadata_and_tooling_are_not_hashed():
    same = {**MINIMAL, "task": {**MINIMAL["task"], "authors": ["me"], "notes": "é", "difficulty": "medium"}, "lint": {"select": ["TL00"]}, "timeouts": {"build_sec": 900}}
    assert manifest.canonical(manifest.validate(same)[0]) == manifest.canonical(manifest.validate(MINIMAL)[0])
    based = {**MINIMAL, "baseline": {}, "resources": {"cpus": 2}, "task": {**MINIMAL["task"], "tags": ["zz", "aa"]}}
    assert manifest.canonical(manifest.validate(based)[0]) == '{"baseline":{},"resources":{"cpus":2.0},"schema_version":1,"task":{"category":"math","id":"my-task","tags":["aa","zz"],"title":"A title","version":"1.0.0"}}'


@pytest.mark.parametrize(
    "changes,expected",
    [
        ({"id": "My"}, ("task.id", "invalid_slug")),
        ({"id": 5}, ("task.id", "string_type")),
        ({"version": "01.0.0"}, ("task.version", "invalid_semver")),
        ({"title": "x"}, ("task.title", "string_too_short")),
        ({"title": "two\nlines"}, ("task.title", "invalid_title")),
        ({"difficulty": "odd"}, ("task.difficulty", "literal_error")),
        ({"tags": ["ok", "NO"]}, ("task.tags[1]", "invalid_tag")),
        ({"tags": ["ok", "ok"]}, ("task.tags", "duplicate_item")),
        ({"tags": [f"t{k}" for k in range(17)]}, ("task.tags", "too_long")),
        ({"tags": "ok"}, ("task.tags", "tuple_type")),
        ({"extra": 1}, ("task.extra", "extra_forbidden")),
        ({"created_at": "2024-01-01"}, ("task.created_at", "date_type")),
    ],
)
def test_task_issues(changes, expected):
    assert task(**changes) == [expected]


def test_other_issues():
    assert issues(resources={"cpus": 0, "memory_mb": True, "network": 1}) == [("resources.cpus", "greater_than"), ("resources.memory_mb", "int_type"), ("resources.network", "bool_type")]
    assert issues(environment={"build_args": {"1x": "a", "ok": 5}}) == [("environment.build_args.1x (key)", "invalid_build_arg")]
    assert issues(instruction={"path": "../x"}, tests={"path": "/t"}, solution={"path": "a\\b"}) == [("instruction.path", "path_escapes_bundle"), ("solution.path", "invalid_path"), ("tests.path", "absolute_path")]
    assert issues(environment={"workdir": "/a//b", "image": "Bad Name", "platform": "x"}) == [("environment.image", "invalid_image_ref"), ("environment.platform", "invalid_platform"), ("environment.workdir", "invalid_workdir")]
    assert issues(verifier={"command": []}, lint={"select": ["tl"]}, odd={}) == [("verifier.command", "too_short"), ("lint.select[0]", "invalid_rule_selector"), ("odd", "extra_forbidden")]
    assert [c for _, c, _ in manifest.validate({})[1]] == ["missing", "missing"]
    assert manifest.best_effort({"tests": {"path": 5}, "solution": {"path": "s"}})["tests"] == {"path": "tests"}


def test_lines_of_fields():
    source = "schema_version = 1\n[task]\nid = 'x'\ntags = [\n 'a']\n[environment.build_args]\nA = 'b'\n"
    assert [manifest.toml_line(source, p) for p in (["task", "id"], ["task", "tags", 0], ["task", "title"], ["environment", "build_args", "A", "[key]"], ["lint"])] == [3, 4, 2, 7, 1]


def test_dockerfile_forms():
    source = textwrap.dedent(f"""\
        # escape=`
        ARG TAG=3.12
        ARG NONE
        FROM --platform=linux/amd64 python:$TAG AS build
        RUN <<EOF
        FROM inside
        EOF
        FROM {PIN} as second
        # comment
        COPY --from=build /a /b
        COPY --chown=1 --from=busybox:1 /a `
          /b
        COPY --from=0 a b
        FROM ${{NONE}}
        FROM ${{OTHER:-scratch}}
        FROM second
    """)
    assert dockerfile.unpinned(source, {}, "environment") == [
        (4, 29, "base image 'python:3.12' (resolved from 'python:$TAG') is not pinned by digest"),
        (11, 23, "COPY --from image 'busybox:1' is not pinned by digest"),
        (14, 6, "base image '${NONE}' depends on build arg NONE, which has no value in the Dockerfile or in [environment].build_args, so its digest cannot be checked"),
    ]
    assert dockerfile.unpinned("ARG I\nFROM $I\n", {"I": PIN}, "verifier") == []
    assert dockerfile.expanded("${A+x}${B:-y}$C", {"A": "", "B": ""}) == ("xy", ["C"])


def test_dockerfile_names(spark):
    names = ["Dockerfile", "a/x.Dockerfile", "dockerfile.dev", "b/Containerfile", "Dockerfile.dockerignore", "mydockerfile", "dockerfile/x"]
    rows = spark.createDataFrame([(n,) for n in names], "file string")
    assert [r.d for r in rows.select(bundle_rules.is_dockerfile().alias("d")).collect()] == [True] * 4 + [False] * 3


def found(source, check):
    return [(line, column, message) for line, column, _, _, message in getattr(python_rules.Source(textwrap.dedent(source)), check)()]


def test_network_in_python():
    got = found('''\
        """curl x"""
        import urllib.request as u
        from requests import get
        from . import socket
        x = ["pip", "install", "y"]
        é = "wget  z"; z = "curly"
    ''', "network")
    assert got == [(2, 1, "grader imports network module 'urllib.request'"), (3, 1, "grader imports network module 'requests'"), (5, 5, "grader runs 'pip install' at test time"), (6, 5, "grader runs 'wget' at test time")]


def test_nondeterminism():
    got = found('''\
        import os, random, time, numpy as np
        from datetime import datetime as dt
        from pathlib import Path
        dt.now(); time.time(); os.urandom(3); random.random(); np.random.rand(); np.random.default_rng(); random.seed()
        sorted(os.listdir()); len({p for p in Path().iterdir()}); list(Path().glob("*")); hash("x"); hash(1)
        s = {1, 2} | set(x)
        for a in s: print(a)
        ",".join(s); f"{s}"; [*s]; [b for b in s]; any(b for b in s); max(s)
        def f(s2=set()): return list(s2)
    ''', "nondeterminism")
    assert [line for line, _, _ in got].count(4) == 7
    assert sorted(m.split("'")[1] for line, _, m in got if line == 5) == [".glob()", "hash()"]
    assert sorted(m.split(" depends")[0] for line, _, m in got if line > 6) == sorted(["a for loop over a set", "'str.join()' of a set", "formatting a set", "unpacking a set", "a comprehension over a set"])
    assert found("import random\nrandom.seed(1)\nrandom.random()\nrandom.Random(2)\n", "nondeterminism") == []


def test_vacuous_tests():
    got = found("def test_a():\n    '''d'''\n    pass\nclass TestX:\n    def test_b(self):\n        assert 1\n    def test_c(self):\n        assert x\ndef helper(): pass\n", "vacuous")
    assert [m.split("'")[1] for _, _, m in got] == ["test_a", "test_b"]


def write(root, files):
    for path, content in files.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)


def test_rules_over_bundles(spark, tmp_path):
    good = 'schema_version = 1\n[task]\nid = "a-b"\nversion = "1.0.0"\ntitle = "Title"\ncategory = "math"\n'
    root = tmp_path / "tasks"
    write(root, {
        "good/task.toml": good, "good/instruction.md": "do", "good/environment/Dockerfile": f"FROM {PIN}\n", "good/verifier/Dockerfile": f"FROM {PIN}\n",
        "good/solution/solve.sh": "echo\n", "good/tests/test_a.py": "def test_a():\n    assert x == 1\n",
        "bad/task.toml": good.replace("a-b", "A") + '[verifier]\ncommand = ["curl", "x"]\n[lint]\nignore = ["TL004", "XX"]\n', "bad/verifier/Dockerfile": 'FROM python:3\nCMD ["pip", "install", "x"]\n',
        "bad/tests/run.sh": "# curl\ngit clone x\n", "bad/tests/test_b.py": "import time\ndef test_b():\n    time.time()\n    import socket\n",
        "none/x.md": "hi", "empty/task.toml": good, "empty/tests/x.txt": "  \n", "odd/task.toml": good, "odd/tests/test_c.py": "def (\n", "odd/tests/test_d.py": "x = 1\n",
    })
    files = bundles.bundle_files(spark, str(root))
    layout = bundle_rules.layouts(bundles.manifests(files))
    rows = bundle_rules.all_findings(files, layout)
    got = sorted((r.bundle, r.file, r.line, r.code) for r in rows.collect())
    assert got == sorted([
        ("bad", "task.toml", 1, "TL003"), ("bad", "verifier/Dockerfile", 1, "TL002"), ("bad", "verifier/Dockerfile", 2, "TL003"), ("bad", "tests/run.sh", 2, "TL003"),
        ("bad", "tests/test_b.py", 3, "TL004"), ("bad", "tests/test_b.py", 4, "TL003"), ("none", "tests", 1, "TL001"), ("empty", "tests", 1, "TL001"),
        ("odd", "tests/test_c.py", 1, "TL001"), ("odd", "tests/test_d.py", 1, "TL001"),
    ])
    rules = lint.rule_table(spark)
    assert "TL004" not in {r.code for r in bundle_rules.enabled(rows, layout, rules).where("bundle = 'bad'").collect()}
    declared = layout.where("declared is not null").selectExpr("bundle", "inline(declared)")
    invalid = bundle_rules.invalid_bundles(layout, bundles.missing_paths(declared, files), rules)
    told = {(r.bundle, r.line, r.message.split(":")[0].split("'")[0]) for r in invalid.collect()}
    assert {("bad", 3, "task.id"), ("bad", 1, "unknown rule selector "), ("none", 1, "missing manifest"), ("empty", 1, "instruction.path")} <= told
    assert not [t for t in told if t[0] == "good"]
