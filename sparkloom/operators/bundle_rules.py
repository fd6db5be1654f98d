"""Rules over whole bundles, as scans of their files: TL000 to TL004.

files(bundle, path, content, size) comes from sources.bundles; layouts are one small row a bundle and are joined to its files.
Sources are parsed where they lie, a file at a time; what depends on a whole folder is told by aggregation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dockerfile, manifest, python_rules
from ..functions.batches import slices
from ..sources.bundles import texts
from .lint import FINDING
from .settled import dealt

_FOUND = "bundle string, file string, line int, column int, end_line int, end_column int, code string, message string"
_PYTEST = r"(?:^|[\s/])(?:py\.test|pytest)(?=$|\s)"
#: Messages of rules that look at folders.
NO_FOLDER, NO_CONTENT = "grader test directory {}/ does not exist", "grader test directory {}/ has no non-empty files"
NO_TEST_FILES = "the verifier runs pytest but {}/ has no test_*.py or *_test.py files"
NO_TESTS, NOT_PARSED = "grader test file defines no test functions", "grader test file does not parse: {}"

_LAYOUT = "bundle string, manifest string, issues array<struct<file string, loc string, code string, message string, line int>>, tests string, solution string, instruction string, command array<string>, verifier string, dockerfiles array<struct<path string, section string, args string>>, select array<string>, ignore array<string>, max_file_kb long, max_bundle_kb long, max_bundle_line int, canonical string, declared array<struct<loc string, path string, kind string>>"


def layouts(parsed: DataFrame) -> DataFrame:
    """parsed(bundle, manifest JSON, issue, source) as sources.bundles.manifests gives it -> one row a bundle: issues of the schema, where things lie
    (sections that are broken have their defaults), what is hashed, and the paths declared (null if the manifest is bad)."""

    schema = _arrow(_LAYOUT)

    def run(stream):
        for batch in slices(stream):
            out = [_layout(*row) for row in zip(*(batch.column(n).to_pylist() for n in ("bundle", "manifest", "issue", "source")))]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return parsed.mapInArrow(run, _LAYOUT).hint("merge")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _layout(bundle: str, text: str | None, issue: str | None, source: str | None) -> dict:
    from ..sources.bundles import revived

    data = revived(text) if text else None
    issues = [{"file": "task.toml", "loc": "", "code": issue, "message": issue.replace("_", " "), "line": 1}] if issue else []
    values, found = manifest.validate(data) if data is not None else (None, [])
    issues += [{"file": "task.toml", "loc": manifest.place(p), "code": c, "message": m, "line": manifest.toml_line(source or "", p)} for p, c, m in found]
    use = values or manifest.best_effort(data)
    return {
        "bundle": bundle, "manifest": text, "issues": issues, "tests": use["tests"]["path"], "solution": use["solution"]["path"], "instruction": use["instruction"]["path"], "command": use["verifier"]["command"],
        "verifier": use["verifier"]["dockerfile"], "dockerfiles": [{"path": use[s]["dockerfile"], "section": s, "args": json.dumps(use[s]["build_args"])} for s in ("environment", "verifier")],
        "select": use["lint"]["select"], "ignore": use["lint"]["ignore"], "max_file_kb": use["lint"]["max_file_kb"], "max_bundle_kb": use["lint"]["max_bundle_kb"], "max_bundle_line": manifest.toml_line(source or "", ["lint", "max_bundle_kb"]),
        "canonical": manifest.canonical(values) if values else None,
        "declared": [dict(zip(("loc", "path", "kind"), d)) for d in manifest.declared_paths(values)] if values else None,
    }


def checked(rows: DataFrame, column: str, check: Callable, name: str) -> DataFrame:
    """rows with the column's values as `name` as the check of a field gives them back, and the code of what is wrong with them instead."""

    def run(stream):
        for batch in stream:
            out = []
            for value in batch.column(batch.schema.get_field_index(column)).to_pylist():
                try:
                    out.append((check(value), None))
                except manifest.Problem as wrong:
                    out.append((None, wrong.code))
            columns = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in columns)], names=[*batch.schema.names, name, "code"])

    return rows.mapInArrow(run, type(rows.schema)([*rows.schema.fields]).add(name, "string").add("code", "string"))


def _laid(files: DataFrame, layout: DataFrame, *columns: str) -> DataFrame:
    """files with columns of their bundle's layout. Both are dealt out by bundle, whatever their size seems to be."""
    return dealt(files, "bundle").join(dealt(layout.select("bundle", *columns), "bundle"), "bundle")


def docker_instructions(files: DataFrame) -> DataFrame:
    """(bundle, file, keyword, value, line, column) of all Dockerfiles by name; the column is the value's."""
    schema = _arrow(columns := "bundle string, file string, keyword string, value string, line int, column int")

    def run(stream):
        for batch in slices(stream):
            rows = [(bundle, file, *step[:4]) for bundle, file, text in zip(*(batch.column(k).to_pylist() for k in range(3))) for step in dockerfile.instructions(text)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    return texts(files).where(is_dockerfile()).select("bundle", "file", "text").mapInArrow(run, columns)


def invalid_bundles(layout: DataFrame, missing: DataFrame, rules: DataFrame) -> DataFrame:
    """TL000: issues of the manifest, declared paths without a file (missing(bundle, loc, path, code)), unknown selectors."""
    issues = layout.select("bundle", F.explode("issues").alias("i")).select("bundle", F.col("i.file").alias("file"), F.col("i.line").alias("line"), F.when(F.col("i.loc") != "", F.concat("i.loc", F.lit(": "), "i.message")).otherwise(F.col("i.message")).alias("message"))
    absent = missing.select("bundle", F.lit("task.toml").alias("file"), F.lit(1).alias("line"), F.concat("loc", F.lit(": "), F.col("code"), F.lit(" '"), "path", F.lit("'")).alias("message"))
    said = layout.select("bundle", F.explode(F.array_union("select", "ignore")).alias("selector"))
    unknown = said.join(F.broadcast(rules.select("code")), F.startswith("code", F.col("selector")) | (F.col("selector") == "ALL"), "left_anti")
    unknown = unknown.select("bundle", F.lit("task.toml").alias("file"), F.lit(1).alias("line"), F.concat(F.lit("unknown rule selector '"), "selector", F.lit("'")).alias("message"))
    every = issues.unionByName(absent).unionByName(unknown)
    return every.select("bundle", "file", "line", F.lit(1).alias("column"), F.lit("TL000").alias("code"), "message")


def _under(folder: str):
    return (F.col(folder) == ".") | F.startswith("file", F.concat(F.col(folder), F.lit("/")))


def _shebang(word: str):
    return F.split_part("text", F.lit("\n"), F.lit(1)).rlike(r"^#!.*\b" + word)


def is_python():
    return F.endswith("file", F.lit(".py")) | _shebang("python")


def is_dockerfile():
    """Dockerfile, Containerfile, and either as a first or last part of a name, but no ignore file."""
    name = F.lower(F.substring_index("file", "/", -1))
    return name.rlike(r"^(.*\.)?(dockerfile|containerfile)$|^(dockerfile|containerfile)\.") & ~F.endswith(name, F.lit(".dockerignore"))


def is_shell():
    return F.col("file").rlike(r"\.(sh|bash)$") | _shebang("(ba|da|z|k)?sh\\b")


def _scanned(rows: DataFrame, columns: list[str], check: Callable[..., Iterator[tuple[str, python_rules.Found]]]) -> DataFrame:
    """check(text, *columns) gives (code, found) for each file of rows(bundle, file, text, ...)."""

    schema = _arrow(_FOUND)

    def run(stream):
        for batch in slices(stream):
            out = []
            for bundle, file, text, *more in zip(*(batch.column(n).to_pylist() for n in ("bundle", "file", "text", *columns))):
                out += [(bundle, file, *place, code, message) for code, (*place, message) in check(text, *more)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return rows.select("bundle", "file", "text", *columns).mapInArrow(run, _FOUND)


def _python(text: str, in_tests: bool, is_test: bool):
    try:
        source = python_rules.Source(text)
    except (SyntaxError, ValueError) as wrong:
        if is_test:
            yield "TL001", (max(getattr(wrong, "lineno", 1) or 1, 1), max(getattr(wrong, "offset", 1) or 1, 1), None, None, NOT_PARSED.format(getattr(wrong, "msg", wrong)))
        return
    if is_test and not source.tests():
        yield "TL001", (1, 1, None, None, NO_TESTS)
    elif is_test:
        yield from (("TL001", x) for x in source.vacuous())
    if in_tests:
        yield from (("TL003", x) for x in source.network())
    yield from (("TL004", x) for x in source.nondeterminism())


def python_files(files: DataFrame, layout: DataFrame) -> DataFrame:
    """TL001, TL003 and TL004 in Python files of the test and solution folders; each is parsed once for all."""
    rows = _laid(texts(files), layout, "tests", "solution", "command").where((_under("tests") | _under("solution")) & is_python())
    name = F.substring_index("file", "/", -1)
    test = _under("tests") & F.endswith(name, F.lit(".py")) & (F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py"))) & F.array_join("command", " ").rlike(_PYTEST)
    return _scanned(rows.select("bundle", "file", "text", _under("tests").alias("in_tests"), test.alias("is_test")), ["in_tests", "is_test"], _python)


def _shell(text: str):
    for number, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        for at, command in python_rules.commands(re.sub(r"(?:^|\s)#.*$", "", line)):
            yield "TL003", (number, at + 1, None, None, f"grader script runs '{command}' at test time")


def shell_files(files: DataFrame, layout: DataFrame) -> DataFrame:
    rows = _laid(texts(files), layout, "tests").where(_under("tests") & is_shell() & ~is_python())
    return _scanned(rows, [], _shell)


def verifier_commands(layout: DataFrame) -> DataFrame:
    """TL003: the manifest's own command."""
    pattern = r"(?:^|(?<=[\s;&|(`'\"]))" + python_rules.NETWORK_COMMAND + r"(?=$|[\s;&|)`'\"])"
    name = F.regexp_replace(F.regexp_extract(F.array_join("command", " "), pattern, 1), r"\s+", " ")
    hit = layout.withColumn("name", name).where("name <> ''")
    return hit.select("bundle", F.lit("task.toml").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("TL003").alias("code"), F.concat(F.lit("verifier command runs '"), "name", F.lit("' at test time")).alias("message"))


def _docker(text: str, args: str | None, section: str | None, starts: bool):
    for line, column, message in dockerfile.unpinned(text, json.loads(args or "{}"), section):
        yield "TL002", (line, column, None, None, message)
    for step in dockerfile.instructions(text) if starts else ():
        if step.keyword in ("CMD", "ENTRYPOINT"):
            try:
                words = json.loads(step.value)
            except ValueError:
                words = None
            value = " ".join(words) if isinstance(words, list) and all(isinstance(w, str) for w in words) else step.value
            if hits := python_rules.commands(value):
                yield "TL003", (step.line, step.column, None, None, f"verifier {step.keyword} runs '{hits[0][1]}' when the grader starts")


def docker_files(files: DataFrame, layout: DataFrame) -> DataFrame:
    """TL002 in Dockerfiles that a manifest declares or that are named so, and TL003 in what the verifier's starts."""
    rows = _laid(texts(files), layout, "dockerfiles", "verifier").withColumn("d", F.get(F.filter("dockerfiles", lambda d: d["path"] == F.col("file")), F.lit(0)))
    rows = rows.select("bundle", "file", "text", "d.section", "d.args", (F.col("file") == F.col("verifier")).alias("starts")).where(F.col("section").isNotNull() | is_dockerfile())
    return _scanned(rows, ["args", "section", "starts"], _docker)


def missing_tests(files: DataFrame, layout: DataFrame) -> DataFrame:
    """TL001 of whole folders: no folder, nothing in it, or no test files for pytest; the first that holds."""
    blank = F.coalesce(F.trim(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\s+", " ")) == "", F.lit(True))
    name = F.substring_index("path", "/", -1)
    inside = _laid(files, layout, "tests").where((F.col("tests") == ".") | F.startswith("path", F.concat("tests", F.lit("/"))))
    counted = inside.groupBy("bundle").agg(F.count("*").alias("n"), F.count_if(~blank).alias("filled"), F.count_if(name.rlike(r"^test_.*\.py$|_test\.py$")).alias("test_files"))
    every = layout.select("bundle", "tests", F.array_join("command", " ").rlike(_PYTEST).alias("pytest")).join(counted.hint("merge"), "bundle", "left")
    said = lambda m: F.replace(F.lit(m), F.lit("{}"), F.col("tests"))
    message = F.when(F.col("n").isNull(), said(NO_FOLDER)).when(F.col("filled") == 0, said(NO_CONTENT)).when(F.col("pytest") & (F.col("test_files") == 0), said(NO_TEST_FILES))
    hit = every.withColumn("message", message).where("message is not null")
    return hit.select("bundle", F.col("tests").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("TL001").alias("code"), "message")


def enabled(found: DataFrame, layout: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings whose rule the bundle's own selection keeps: the longer selector wins, and ignore wins ties."""
    best = lambda c: F.array_max(F.transform(c, lambda s: F.when(s == "ALL", 0).when(F.startswith("f.code", s), F.length(s))))
    s, i = F.when(F.size("l.select") == 0, 0).otherwise(best("l.select")), best("l.ignore")
    known = found.join(F.broadcast(rules.select("code")), "code", "left_semi").select(found.columns)
    keeps = (F.col("f.bundle") == F.col("l.bundle")) & s.isNotNull() & (i.isNull() | (s > i))
    return known.alias("f").join(layout.select("bundle", "select", "ignore").hint("merge").alias("l"), keeps, "left_semi")


def all_findings(files: DataFrame, layout: DataFrame) -> DataFrame:
    """FINDING columns of TL001 to TL004."""
    parts = [python_files(files, layout), shell_files(files, layout), docker_files(files, layout), verifier_commands(layout), missing_tests(files, layout)]
    out = parts[0].select(*FINDING)
    for part in parts[1:]:
        out = out.unionByName(part.select(*FINDING))
    return out
