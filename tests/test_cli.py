"""Bundles on disk from a shell: validate, hash, similar, lint, cache and ledger, by exit codes and what is printed."""

import json

import pytest

from sparkloom.cli import main
from sparkloom.operators import rules

PIN = "python:3.12@sha256:" + "5a" * 32


def bundle(root, name, **files):
    made = {
        "task.toml": f'schema_version = 1\n[task]\nid = "{name}"\nversion = "1.0.0"\ntitle = "A task called {name}"\ncategory = "maths"\n',
        "instruction.md": f"Find the {name} of all the numbers in the file and print it with three digits. " + " ".join(f"{name}{k}" for k in range(40)),
        "environment/Dockerfile": f"FROM {PIN}\n",
        "verifier/Dockerfile": f"FROM {PIN}\n",
        "solution/solve.sh": "python solve.py\n",
        "solution/solve.py": f"def of_{name}(x):\n    return x + {len(name)}\n",
        "tests/test_it.py": "def test_it():\n    assert 1 + 1 == 2\n",
    } | {k.replace("__", "/").replace("_py", ".py").replace("_toml", ".toml"): v for k, v in files.items()}
    for path, text in made.items():
        if text is not None:
            at = root / name / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
    return str(root / name)


@pytest.fixture()
def run(spark, capsys):
    def call(*arguments):
        code = main(list(map(str, arguments)), spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    return call


def rows(out):
    return [json.loads(line) for line in out.splitlines()]


def test_validate_hash_and_similar(run, tmp_path):
    good, bad = bundle(tmp_path, "sum"), bundle(tmp_path, "mean", task_toml='schema_version = 2\n[task]\nid = "X"\n')
    code, out, _ = run("validate", good, bad, tmp_path / "none")
    told = {r["bundle"]: r for r in rows(out)}
    assert code == 1 and told[good]["valid"] and {(i["loc"], i["code"]) for i in told[bad]["issues"]} >= {("schema_version", "literal_error"), ("task.id", "invalid_slug"), ("task.title", "missing")}
    code, out, err = run("hash", good)
    (first,) = rows(out)
    assert code == 0 and first["root"].startswith("sha256:") and err == ""
    with open(f"{good}/instruction.md") as f:
        text = f.read()
    open(f"{good}/instruction.md", "w", newline="").write(text.replace("\n", "\r\n"))
    open(f"{good}/task.toml", "a").write('notes = "not hashed"\n')
    assert rows(run("hash", good)[1]) == [first]
    open(f"{good}/instruction.md", "a").write("more")
    assert rows(run("hash", good)[1]) != [first]
    twin = bundle(tmp_path, "total", instruction="x", **{"solution__solve_py": "def other(y):  # renamed\n    return y + 3\n"})
    code, out, _ = run("similar", good, twin, "--threshold", "0.9")
    assert code == 1 and [(r["a"], r["b"], r["solution_similarity"]) for r in rows(out)] == [(good, twin, 1.0)]
    code, _, err = run("hash", bad)
    assert code == 1 and "issues" in err


def test_lint(run, tmp_path):
    secret = "gh" + "p_" + "a1B2c3D4e5F6a1B2c3D4e5F6a1B2c3D4e5F6"
    path = bundle(tmp_path, "flawed", tests__test_it_py=f"import socket\nimport time\ndef test_it():\n    assert time.time()  # sparkloom: ignore[TL004]\nKEY = '{secret}'\n", environment__Dockerfile="FROM python:3.12\n")
    clean = bundle(tmp_path, "clean")
    code, out, _ = run("lint", path, clean)
    assert code == 1 and out.splitlines()[-1] == "Found 3 findings (3 errors) in 1 of 2 bundles. 1 suppressed inline." and secret not in out
    places = [line.split(": ")[0] for line in out.splitlines() if line.startswith(("environment", "tests"))]
    assert places == ["environment/Dockerfile:1:6", "tests/test_it.py:1:1", "tests/test_it.py:5:8"]
    assert run("lint", clean)[:2] == (0, "No findings in 1 bundle.\n")
    code, out, _ = run("lint", path, "--select", "TL002,TL006", "--ignore", "TL006", "--format", "json")
    assert [f["code"] for f in json.loads(out)["findings"]] == ["TL002"]
    code, out, _ = run("lint", path, "--format", "sarif")
    log = json.loads(out)
    assert code == 1 and len(log["runs"][0]["results"]) == 3 and len(log["runs"][0]["tool"]["driver"]["rules"]) == 7
    assert run("lint", path, "--select", "XX9")[0] == 2 and run("lint")[0] == 2
    open(f"{clean}/task.toml", "a").write("[lint]\nmax_file_kb = 1\nmax_bundle_kb = 2\n")
    open(f"{clean}/tests/data.txt", "w").write("x" * 3000)
    code, out, _ = run("lint", clean)
    assert [line.split(": ")[0] for line in out.splitlines()[1:-1] if not line.startswith("    ")] == ["task.toml:9:1", "tests/data.txt:1:1"] and "file is 2.9 KiB (3000 bytes), over the per-file limit of 1 KiB" in out
    assert [json.loads(line)["code"] for line in run("rules")[1].splitlines()] == [f"TL00{k}" for k in range(7)] and run("version")[0] == 0


def test_cache(run, tmp_path):
    one, cache = bundle(tmp_path, "sum"), ("--cache", tmp_path / "cache")
    code, out, _ = run("cache-put", one, *cache)
    (put,) = rows(out)
    assert code == 0 and put["objects"] == put["new_objects"] == 7  # six different contents and the tree
    (again,) = rows(run("cache-put", one, *cache)[1])
    assert again["new_objects"] == 0 and again["tree"] == put["tree"]
    code, out, _ = run("cache-get", put["tree"], "--output", tmp_path / "tree.json", *cache)
    tree = json.loads((tmp_path / "tree.json").read_text())
    assert code == 0 and [e["path"] for e in tree["entries"]][:2] == ["environment/Dockerfile", "instruction.md"]
    assert run("cache-has", put["tree"], *cache)[0] == 0 and run("cache-has", "0" * 64, *cache)[0] == 1 and run("cache-get", "0" * 64, *cache)[0] == 1
    assert run("cache-gc", "1Q", *cache)[0] == 2 and json.loads(run("cache-gc", "0", *cache)[1])["kept"] == 0


def test_ledger(run, tmp_path):
    other = "class Mean:\n    def get(self, rows):\n        kept = [r / 7 for r in rows if r]\n        return max(kept) - min(kept)\n"
    book, one, two = ("--ledger", tmp_path / "book"), bundle(tmp_path, "sum"), bundle(tmp_path, "mean", solution__solve_py=other)
    assert run("ledger-init", *book)[0] == 0
    code, out, _ = run("ledger-register", one, two, "--actor", "ann", *book)
    assert code == 0 and {r["slug"]: r["status"] for r in rows(out)} == {"sum": "registered", "mean": "registered"}
    assert run("ledger-check", one, *book)[0] == 1 and run("ledger-register", one, "--actor", "ann", *book)[0] == 1
    near = bundle(tmp_path, "total")
    assert [r["status"] for r in rows(run("ledger-register", near, "--actor", "ann", *book)[1])] == ["near_duplicate"]
    assert run("ledger-transition", "sum", "submitted", "--actor", "bo", "--note", "ready", *book)[0] == 0
    assert run("ledger-transition", "sum", "accepted", "--actor", "bo", *book)[0] == 1
    open(f"{two}/instruction.md", "a").write(" more")
    assert run("ledger-revise", two, "--actor", "ann", *book)[0] == 0
    (status,) = rows(run("ledger-status", "sum", *book)[1])
    assert status["status"] == "submitted" and run("ledger-status", "none", *book)[0] == 1
    assert [json.loads(x)["action"] for x in run("ledger-history", *book)[1].splitlines()] == ["register", "register", "transition", "revise"]
    code, out, _ = run("ledger-verify", *book)
    assert code == 0 and rows(out)[0]["entries"] == 4


def test_registry(spark):
    registry = rules.Registry()
    said = {"severity": "warning", "description": "d", "fix": "f"}

    @registry.rule("XY100", "no-readme", **said)
    def no_readme(files, layout):
        missing = layout.join(files.where("path = 'README.md'"), "bundle", "left_anti")
        return missing.selectExpr("bundle", "'' AS file", "1 AS line", "1 AS column", "'XY100' AS code", "'no README.md' AS message")

    for code, name, change in (("xy1", "a", {}), ("XY101", "Bad Name", {}), ("XY100", "other", {}), ("XY101", "no-readme", {}), ("XY101", "ok", {"fix": " "}), ("XY101", "ok", {"severity": "fatal"})):
        with pytest.raises(ValueError):
            registry.rule(code, name, **(said | change))(no_readme)
    assert [r.code for r in registry] == ["XY100"] and len(registry) == 1 and "XY100" in registry and registry.get("XY100").check is no_readme
    assert registry.unknown(["ALL", "XY", "TL001", "xy"]) == ["TL001", "xy"]
    files = spark.createDataFrame([("b", "README.md", bytearray(b""), 0), ("c", "x", bytearray(b""), 0)], "bundle string, path string, content binary, size long")
    layout = spark.createDataFrame([("b", [], []), ("c", [], [])], "bundle string, select array<string>, ignore array<string>")
    found, _ = rules.linted(files, layout, registry=registry)
    assert [(r.bundle, r.message) for r in found.collect()] == [("c", "no README.md")]
    with pytest.raises(ValueError):
        rules.linted(files, layout, [("select", "TL001")], registry)
