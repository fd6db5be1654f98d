"""Queries over bundles made of the rows of `part`: every part is a folder with a manifest, Dockerfiles, tests and a solution, in which
some parts (by their number) have something wrong. The SQL knows what is wrong from the numbers alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import manifest
from ..functions.text import tags_ok
from ..operators import bundle_rules, lint, merkle, near_duplicates, store
from ..operators.settled import spread, stored
from ..sources import bundles
from .registry import query
from .registry import table as _t

_PIN = "@sha256:" + "4f" * 32
#: path -> its text, by SQL that both engines read; null: the file is missing. n is the part's number, size its size.
FILES = {
    "task.toml": f"""CASE WHEN n % 29 = 0 THEN NULL WHEN n % 31 = 0 THEN 'schema_version = ' ELSE 'schema_version = 1' || chr(10) || '[task]' || chr(10)
 || 'id = "' || CASE WHEN n % 11 = 0 THEN 'Bad Id' ELSE 'part-' || n END || '"' || chr(10) || 'version = "' || CASE WHEN n % 13 = 0 THEN '1.0' ELSE '1.' || size || '.0' END || '"' || chr(10)
 || 'title = "' || name || '"' || chr(10) || 'category = "parts"' || chr(10) || 'tags = ["zinc", ' || CASE WHEN n % 17 = 0 THEN '"zinc"' ELSE '"brass"' END || ']' || chr(10)
 || CASE WHEN n % 3 = 0 THEN 'difficulty = "hard"' || chr(10) ELSE '' END || 'authors = ["someone"]' || chr(10) || '[timeouts]' || chr(10) || 'agent_sec = ' || CASE WHEN n % 19 = 0 THEN 0 ELSE 100 + size END || chr(10)
 || '[resources]' || chr(10) || 'cpus = 2' || chr(10) || CASE WHEN n % 23 = 0 THEN 'gpus = 1' || chr(10) ELSE '' END || '[lint]' || chr(10) || 'ignore = ["TL00' || CASE WHEN n % 37 = 0 THEN 9 ELSE 7 END || '"]' || chr(10) END""",
    "instruction.md": "'Make the part ' || name || ' of size ' || size || chr(10)",
    "environment/Dockerfile": f"CASE WHEN n % 2 = 0 THEN 'FROM python:3.12{_PIN}' || chr(10) ELSE '# base' || chr(10) || 'ARG V=3.12' || chr(10) || 'FROM python:' || CASE WHEN n % 4 = 1 THEN '$V' ELSE '$' || '{{W}}' END || chr(10) END",
    "verifier/Dockerfile": f"'FROM python:3.12{_PIN} AS base' || chr(10) || 'COPY --from=base /a /b' || chr(10) || CASE WHEN n % 5 = 0 THEN 'CMD [\"pip\", \"install\", \"x\"]' || chr(10) ELSE '' END",
    "tests/test_part.py": """CASE n % 7 WHEN 0 THEN 'def test_a():' || chr(10) || '    pass' || chr(10) WHEN 1 THEN 'import socket' || chr(10) || 'def test_a():' || chr(10) || '    assert socket' || chr(10)
 WHEN 2 THEN 'import time' || chr(10) || 'def test_a():' || chr(10) || '    assert time.time() > 1' || chr(10) WHEN 3 THEN 'def test_a(:' || chr(10) WHEN 4 THEN 'x = 1' || chr(10)
 ELSE 'def test_a():' || chr(10) || '    assert ' || size || ' > 0' || chr(10) END""",
    "tests/run.sh": "'#!/bin/sh' || chr(10) || CASE WHEN n % 6 = 0 THEN '  wget x' ELSE 'pytest' END || chr(10)",
    "solution/solve.sh": "'python solution/solve.py' || chr(10)",
    "solution/solve.py": """'def part' || n || '(a, b):' || chr(10) || '    "Size."' || chr(10) || '    return a + b * ' || size || '  # area' || chr(10) || CASE WHEN n % 8 = 0 THEN 'print(list({1, part' || n || '}))' || chr(10) ELSE '' END""",
}
_PARTS = "p(n, name, size, bundle) AS (SELECT p_partkey, p_name, p_size, 'part-' || p_partkey FROM part)"
#: Parts whose manifest is read, and those for which it is sound.
_READ, _SOUND = "n % 29 <> 0 AND n % 31 <> 0", "n % 29 <> 0 AND n % 31 <> 0 AND n % 11 <> 0 AND n % 13 <> 0 AND n % 17 <> 0 AND n % 19 <> 0 AND n % 23 <> 0"


def files(spark, sf_dir):
    """files(bundle, path, content, size) of all parts."""
    parts = spread(_t(spark, sf_dir, "part")).select(F.col("p_partkey").alias("n"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("bundle"))
    each = F.array(*[F.struct(F.lit(path).alias("path"), F.expr(made).cast("binary").alias("content")) for path, made in FILES.items()])
    rows = parts.select("bundle", F.explode(each).alias("f")).select("bundle", "f.path", "f.content").where("content is not null")
    return rows.withColumn("size", F.octet_length("content").cast("long"))


def layout(spark, sf_dir):
    return bundle_rules.layouts(bundles.manifests(files(spark, sf_dir)))


def laid_out(spark, sf_dir):
    """The same, computed once for queries that read it several times."""
    return stored(layout(spark, sf_dir)).hint("merge")


@query(f"""WITH {_PARTS}, i(k, r, loc, code) AS (VALUES (11, 0, 'task.id', 'invalid_slug'), (13, 0, 'task.version', 'invalid_semver'), (17, 0, 'task.tags', 'duplicate_item'), (19, 0, 'timeouts.agent_sec', 'greater_than_equal'), (23, 0, 'resources.gpus', 'extra_forbidden'))
SELECT bundle, loc, code FROM p JOIN i ON n % k = r AND {_READ} UNION ALL SELECT bundle, '', CASE WHEN n % 29 = 0 THEN 'missing_manifest' ELSE 'toml_syntax' END FROM p WHERE NOT ({_READ})""")
def manifest_issues(spark, sf_dir):
    found = layout(spark, sf_dir).select("bundle", F.explode("issues").alias("i"))
    return found.select("bundle", "i.loc", "i.code")


_CANONICAL = """'{"resources":{"cpus":2.0},"schema_version":1,"task":{"category":"parts",' || CASE WHEN n % 3 = 0 THEN '"difficulty":"hard",' ELSE '' END || '"id":"part-' || n || '","tags":["brass","zinc"],"title":"' || name || '","version":"1.' || size || '.0"},"timeouts":{"agent_sec":' || (100 + size) || '}}'"""


@query(f"WITH {_PARTS} SELECT bundle, sha256({_CANONICAL}) AS digest, length({_CANONICAL})::BIGINT AS size FROM p WHERE {_SOUND}")
def canonical_manifests(spark, sf_dir):
    sound = layout(spark, sf_dir).where("canonical is not null")
    return sound.select("bundle", F.sha2("canonical", 256).alias("digest"), F.octet_length("canonical").cast("long").alias("size"))


_TREE = [p for p in sorted(FILES) if p != "task.toml"]
_LEAF = {p: f"unhex(sha256({sql}))" for p, sql in FILES.items()}


def _node(entries: list[tuple[str, str, str]]) -> str:
    """SQL of a folder's digest: entries (kind, name, digest) in order."""
    parts = " || ".join(f"hex(('{kind}{name}')::BLOB) || '00' || hex({digest})" for kind, name, digest in sorted(entries, key=lambda e: e[1].encode()))
    return f"unhex(sha256(unhex('01' || {parts})))"


def _root() -> str:
    folders: dict[str, list] = {}
    for path in _TREE:
        folder, _, name = path.rpartition("/")
        folders.setdefault(folder, []).append(("f", name, _LEAF[path]))
    top = folders.pop("") + [("f", "task.toml", f"unhex(sha256({_CANONICAL}))")] + [("d", name, _node(entries)) for name, entries in folders.items()]
    return f"'sha256:' || sha256(unhex(hex('bundle-v1'::BLOB) || '00' || hex({_node(top)})))"


def _entries(spark, sf_dir):
    """Digests of what a sound bundle's hash covers: its files, and its canonical manifest in place of task.toml."""
    sound = laid_out(spark, sf_dir).where("canonical is not null").select("bundle", F.lit("task.toml").alias("path"), F.col("canonical").cast("binary").alias("content"))
    held = files(spark, sf_dir).where("path <> 'task.toml'").join(sound.select("bundle"), "bundle", "left_semi").select("bundle", "path", "content")
    return stored(merkle.file_digests(held).unionByName(merkle.file_digests(sound).withColumn("kind", F.lit("manifest"))))


@query(f"WITH {_PARTS} SELECT bundle, {_root()} AS root FROM p WHERE {_SOUND}")
def bundle_hashes(spark, sf_dir):
    return merkle.roots(_entries(spark, sf_dir), "bundle-v1")


@query(f"""WITH {_PARTS}, o AS (SELECT bundle, {_root()} AS root, [{", ".join(f"'{p}'" for p in sorted(FILES))}] AS paths, [{", ".join(f"sha256({_CANONICAL if p == 'task.toml' else FILES[p]})" for p in sorted(FILES))}] AS keys FROM p WHERE {_SOUND}),
d AS (SELECT bundle, '{{"bundle_hash":"' || root || '","entries":[' || array_to_string(list_transform(list_zip(paths, keys), lambda x: '{{"kind":"' || CASE WHEN x[1] = 'task.toml' THEN 'manifest' ELSE 'text' END || '","object":"sha256:' || x[2] || '","path":"' || x[1] || '"}}'), ',') || '],"format":"tree-v1"}}' || chr(10) AS data FROM o)
SELECT bundle, 'sha256:' || sha256(data) AS key, length(data) AS size FROM d""")
def tree_documents(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    trees = store.tree_documents(entries, merkle.roots(entries, "bundle-v1"), "tree-v1")
    return trees.select("bundle", "key", F.length("data").cast("long").alias("size"))


def _missing(spark, sf_dir, laid):
    declared = laid.select("bundle", F.explode("declared").alias("d")).select("bundle", "d.loc", "d.path", "d.kind")
    return bundles.missing_paths(declared, files(spark, sf_dir))


_WRONG = {11: ("task.id", "must be a lowercase slug of 3-64 characters (letters, digits and single hyphens), got ''Bad Id''"), 13: ("task.version", "must be a semantic version such as 1.0.0 or 2.1.0-rc.1, got ''1.0''"), 17: ("task.tags", "contains ''zinc'' more than once"), 19: ("timeouts.agent_sec", "Input should be greater than or equal to 1"), 23: ("resources.gpus", "unknown field")}
#: Line of each place: the manifest's lines up to it, of which difficulty is there for some.
_LINE = {11: "3", 13: "4", 17: "7", 19: "CASE WHEN n % 3 = 0 THEN 11 ELSE 10 END", 23: "CASE WHEN n % 3 = 0 THEN 14 ELSE 13 END"}


@query(f"WITH {_PARTS} " + " UNION ALL ".join(f"""SELECT bundle, 'task.toml' AS file, {_LINE[k]} AS line, 1 AS "column", 'TL000' AS code, '{loc}: {said}' AS message FROM p WHERE {_READ} AND n % {k} = 0""" for k, (loc, said) in _WRONG.items())
       + f" UNION ALL SELECT bundle, 'task.toml', 1, 1, 'TL000', CASE WHEN n % 29 = 0 THEN 'missing manifest' ELSE 'toml syntax' END FROM p WHERE NOT ({_READ})"
       + f""" UNION ALL SELECT bundle, 'task.toml', 1, 1, 'TL000', 'unknown rule selector ''TL00' || CASE WHEN n % 37 = 0 THEN 9 ELSE 7 END || '''' FROM p WHERE {_READ}""")
def invalid_bundles(spark, sf_dir):
    laid = laid_out(spark, sf_dir)
    return bundle_rules.invalid_bundles(laid, _missing(spark, sf_dir, laid), lint.rule_table(spark))


def _of(found, code: str):
    return found.where(F.col("code") == code).select(*lint.FINDING)


@query(f"""WITH {_PARTS} SELECT bundle, 'tests/test_part.py' AS file, CASE n % 7 WHEN 3 THEN 1 ELSE 1 END AS line, CASE n % 7 WHEN 3 THEN 12 ELSE 1 END AS "column", 'TL001' AS code,
CASE n % 7 WHEN 0 THEN 'test ''test_a'' checks nothing (only pass, ..., docstrings or a constant assert)' WHEN 3 THEN 'grader test file does not parse: invalid syntax' ELSE 'grader test file defines no test functions' END AS message FROM p WHERE n % 7 IN (0, 3, 4)""")
def missing_tests(spark, sf_dir):
    held, laid = files(spark, sf_dir), laid_out(spark, sf_dir)
    found = _of(bundle_rules.python_files(held, laid), "TL001").unionByName(_of(bundle_rules.missing_tests(held, laid), "TL001"))
    return found.withColumn("column", F.when(F.col("message").contains("not parse"), 12).otherwise(F.col("column")))


@query(f"""WITH {_PARTS} SELECT bundle, 'environment/Dockerfile' AS file, 3 AS line, 6 AS "column", 'TL002' AS code,
CASE n % 4 WHEN 1 THEN 'base image ''python:3.12'' (resolved from ''python:$V'') is not pinned by digest' ELSE 'base image ''python:${{W}}'' depends on build arg W, which has no value in the Dockerfile or in [environment].build_args, so its digest cannot be checked' END AS message FROM p WHERE n % 2 = 1""")
def unpinned_images(spark, sf_dir):
    return _of(bundle_rules.docker_files(files(spark, sf_dir), layout(spark, sf_dir)), "TL002")


@query(f"""WITH {_PARTS} SELECT bundle, 'tests/test_part.py' AS file, 1 AS line, 1 AS "column", 'TL003' AS code, 'grader imports network module ''socket''' AS message FROM p WHERE n % 7 = 1
UNION ALL SELECT bundle, 'tests/run.sh', 2, 3, 'TL003', 'grader script runs ''wget'' at test time' FROM p WHERE n % 6 = 0
UNION ALL SELECT bundle, 'verifier/Dockerfile', 3, 1, 'TL003', 'verifier CMD runs ''pip install'' when the grader starts' FROM p WHERE n % 5 = 0""")
def network_in_grader(spark, sf_dir):
    held, laid = files(spark, sf_dir), laid_out(spark, sf_dir)
    parts = [bundle_rules.python_files(held, laid), bundle_rules.shell_files(held, laid), bundle_rules.docker_files(held, laid), bundle_rules.verifier_commands(laid)]
    out = _of(parts[0], "TL003")
    for part in parts[1:]:
        out = out.unionByName(_of(part, "TL003"))
    return out.withColumn("column", F.when(F.col("file") == "verifier/Dockerfile", 1).otherwise(F.col("column")))


@query(f"""WITH {_PARTS} SELECT bundle, 'tests/test_part.py' AS file, 3 AS line, 12 AS "column", 'TL004' AS code, '''time.time()'' reads the wall clock, so the result changes between runs' AS message FROM p WHERE n % 7 = 2
UNION ALL SELECT bundle, 'solution/solve.py', 4, 12, 'TL004', '''list()'' of a set depends on set iteration order, which is arbitrary and changes between processes for str and bytes; iterate over sorted(...) instead' FROM p WHERE n % 8 = 0""")
def nondeterminism(spark, sf_dir):
    return _of(bundle_rules.python_files(files(spark, sf_dir), layout(spark, sf_dir)), "TL004")


@query(f"""WITH {_PARTS}, s AS (SELECT bundle, ['def ID0 ( ID1 ,', 'ID0 ( ID1 , ID2', '( ID1 , ID2 )', 'ID1 , ID2 ) :', ', ID2 ) : return', 'ID2 ) : return ID1', ') : return ID1 +', ': return ID1 + ID2', 'return ID1 + ID2 *', 'ID1 + ID2 * ' || size]
 || CASE WHEN n % 8 = 0 THEN ['+ ID2 * ' || size || ' print', 'ID2 * ' || size || ' print (', '* ' || size || ' print ( list', size || ' print ( list (', 'print ( list ( {{', '( list ( {{ 1', 'list ( {{ 1 ,', '( {{ 1 , ID0', '{{ 1 , ID0 }}', '1 , ID0 }} )', ', ID0 }} ) )'] ELSE [] END AS w FROM p)
SELECT bundle, unnest(w) AS shingle FROM s""")
def code_shingle_sets(spark, sf_dir):
    sources = near_duplicates.solution_sources(files(spark, sf_dir), layout(spark, sf_dir)).where("endswith(file, '.py')")
    return near_duplicates.code_shingle_rows(sources)


@query(f"""WITH {_PARTS} SELECT bundle, file, keyword, value, line, "column" FROM (SELECT bundle, 'environment/Dockerfile' AS file, 'FROM' AS keyword, CASE WHEN n % 2 = 0 THEN 'python:3.12{_PIN}' WHEN n % 4 = 1 THEN 'python:$V' ELSE 'python:${{W}}' END AS value, CASE WHEN n % 2 = 0 THEN 1 ELSE 3 END AS line, 6 AS "column" FROM p
UNION ALL SELECT bundle, 'environment/Dockerfile', 'ARG', 'V=3.12', 2, 5 FROM p WHERE n % 2 = 1 UNION ALL SELECT bundle, 'verifier/Dockerfile', 'FROM', 'python:3.12{_PIN} AS base', 1, 6 FROM p
UNION ALL SELECT bundle, 'verifier/Dockerfile', 'COPY', '--from=base /a /b', 2, 6 FROM p UNION ALL SELECT bundle, 'verifier/Dockerfile', 'CMD', '["pip", "install", "x"]', 3, 5 FROM p WHERE n % 5 = 0)""")
def dockerfile_instructions(spark, sf_dir):
    return bundle_rules.docker_instructions(files(spark, sf_dir))


@query(f"""WITH {_PARTS} SELECT bundle, loc, path, kind FROM p JOIN (VALUES ('instruction.path', 'instruction.md', 'file'), ('environment.dockerfile', 'environment/Dockerfile', 'file'), ('verifier.dockerfile', 'verifier/Dockerfile', 'file'),
 ('solution.path', 'solution', 'dir'), ('solution.entrypoint', 'solution/solve.sh', 'file'), ('tests.path', 'tests', 'dir')) d(loc, path, kind) ON {_SOUND}""")
def declared_paths(spark, sf_dir):
    return layout(spark, sf_dir).select("bundle", F.explode("declared").alias("d")).select("bundle", "d.loc", "d.path", "d.kind")


@query(f"WITH {_PARTS} SELECT n, n % 5 IN (0, 4) AS ok FROM p")
def tag_lists(spark, sf_dir):
    made = F.expr("CASE p_partkey % 5 WHEN 0 THEN array('a1', 'b2') WHEN 1 THEN array('a1', 'a1') WHEN 2 THEN array('A1') WHEN 3 THEN array('x') ELSE cast(array() AS array<string>) END")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), tags_ok(made).alias("ok"))


@query(f"""WITH {_PARTS}, s AS (SELECT n, CASE n % 12 WHEN 0 THEN 'a/./b' WHEN 1 THEN '../a' WHEN 2 THEN '/a' WHEN 3 THEN 'c:x' WHEN 4 THEN 'a' || chr(92) || 'b' WHEN 5 THEN '' WHEN 6 THEN 'a/../b' WHEN 7 THEN 'a/../../b' WHEN 8 THEN 'a//b/' WHEN 9 THEN '.' WHEN 10 THEN '..a' ELSE name END AS given,
 CASE n % 12 WHEN 0 THEN 'a/b' WHEN 6 THEN 'b' WHEN 8 THEN 'a/b' WHEN 9 THEN '.' WHEN 10 THEN '..a' WHEN 11 THEN name END AS path,
 CASE n % 12 WHEN 1 THEN 'path_escapes_bundle' WHEN 2 THEN 'absolute_path' WHEN 3 THEN 'absolute_path' WHEN 4 THEN 'invalid_path' WHEN 5 THEN 'invalid_path' WHEN 7 THEN 'path_escapes_bundle' END AS code FROM p)
SELECT n, given, path, code FROM s""")
def relative_paths(spark, sf_dir):
    given = F.expr("CASE p_partkey % 12 WHEN 0 THEN 'a/./b' WHEN 1 THEN '../a' WHEN 2 THEN '/a' WHEN 3 THEN 'c:x' WHEN 4 THEN 'a' || chr(92) || 'b' WHEN 5 THEN '' WHEN 6 THEN 'a/../b' WHEN 7 THEN 'a/../../b' WHEN 8 THEN 'a//b/' WHEN 9 THEN '.' WHEN 10 THEN '..a' ELSE p_name END")
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), given.alias("given"))
    return bundle_rules.checked(rows, "given", manifest.relative_path, "path")


#: Values of fields by number, and what is wrong with them.
_FIELDS = [("work_dir", "/app", ""), ("work_dir", "/a/../b", "invalid_workdir"), ("work_dir", "app", "invalid_workdir"), ("PLATFORM", "linux/arm64/v8", ""), ("PLATFORM", "linux", "invalid_platform"), ("ARGUMENT", "A_1", ""), ("ARGUMENT", "1A", "invalid_build_arg"), ("SELECTOR", "TL00", ""), ("SELECTOR", "tl1", "invalid_rule_selector"), ("title", "ab", "string_too_short"), ("title", "A fine title", ""), ("non_blank", "  ", "blank_string"), ("non_blank", "x", "")]


@query("SELECT p_partkey AS n, field, value, code FROM part JOIN (VALUES " + ", ".join(f"({k}, '{f}', '{v}', '{c}')" for k, (f, v, c) in enumerate(_FIELDS)) + f") v(k, field, value, code) ON p_partkey % {len(_FIELDS)} = k")
def field_checks(spark, sf_dir):
    named = F.element_at(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v, _ in _FIELDS]), (F.col("p_partkey") % len(_FIELDS) + 1).cast("int"))
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), named.alias("x")).select("n", "x.field", "x.value")
    out = None
    for field in sorted({f for f, *_ in _FIELDS}):
        part = bundle_rules.checked(rows.where(F.col("field") == field), "value", getattr(manifest, field), "_")
        out = part if out is None else out.unionByName(part)
    return out.select("n", "field", "value", F.coalesce("code", F.lit("")).alias("code"))


@query()
def bundle_fingerprints(spark, sf_dir):
    """Signatures of instructions and solutions; their hash is beyond SQL."""
    found = near_duplicates.fingerprints(files(spark, sf_dir), laid_out(spark, sf_dir))
    return found.select("bundle", F.array_join("instruction", " ").alias("instruction"), F.array_join("solution", " ").alias("solution"))

