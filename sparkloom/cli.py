"""python -m sparkloom.cli: what api offers, from a shell. Exit codes: 0 done, 1 something was found or refused, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .api import TREE_TAG, Bundles, Ledger, ObjectStore, Settings, report, uri
from .functions.text import parse_size
from .operators import merkle, rules


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> None:
        made = commands.add_parser(name)
        for flags, options in arguments:
            made.add_argument(*flags, **options)

    paths = (["paths"], {"nargs": "+"})
    threshold = (["--threshold"], {"type": float, "default": 0.5})
    cache, book, actor = (["--cache"], {}), (["--ledger"], {}), (["--actor"], {"required": True})
    command("version")
    command("rules")
    command("validate", paths)
    command("hash", paths)
    command("similar", paths, threshold)
    command("lint", paths, (["--format"], {"choices": ["text", "json", "sarif"], "default": "text"}), (["--select"], {"action": "append", "default": []}), (["--ignore"], {"action": "append", "default": []}))
    command("cache-put", paths, cache)
    command("cache-get", (["key"], {}), (["--output"], {}), cache)
    command("cache-has", (["keys"], {"nargs": "+"}), cache)
    command("cache-gc", (["max_size"], {}), cache)
    command("ledger-init", book)
    command("ledger-register", paths, actor, threshold, (["--allow-near-dup"], {"action": "store_true"}), book)
    command("ledger-check", paths, threshold, book)
    command("ledger-revise", paths, actor, book)
    command("ledger-status", (["slug"], {}), book)
    command("ledger-transition", (["slug"], {}), (["target"], {}), actor, (["--note"], {}), book)
    command("ledger-history", (["slug"], {"nargs": "?"}), book)
    command("ledger-verify", book)
    return parser


def _told(rows: DataFrame, *order: str) -> list:
    out = rows.orderBy(*order).toJSON().collect() if order else rows.toJSON().collect()
    for line in out:
        print(line)
    return [json.loads(line) for line in out]


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(arguments)
    except SystemExit as stop:
        return int(stop.code or 0)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "rules":
        for rule in rules.RULES:
            print(json.dumps(dict(zip(("code", "name", "severity", "description", "fix"), rule[:5]))))
        return 0
    spark = spark or SparkSession.builder.appName("sparkloom").getOrCreate()
    kind, _, step = args.command.partition("-")
    settings = Settings()
    if kind == "cache":
        return _cache(args, step, spark, ObjectStore(spark, uri(args.cache or settings.cache)))
    if kind == "ledger":
        return _ledger(args, step, spark, Ledger(spark, uri(args.ledger or settings.ledger)))
    if args.command == "lint":
        split = lambda given: [s.strip() for x in given for s in x.split(",") if s.strip()]
        select, ignore = split(args.select), split(args.ignore)
        if bad := rules.RULES.unknown([*select, *ignore]):
            print(f"unknown rule selectors: {', '.join(bad)}", file=sys.stderr)
            return 2
        document, code = report(Bundles(spark, args.paths), args.format, select, ignore)
        print(document)
        return code
    held = Bundles(spark, args.paths)
    if args.command == "validate":
        return int(not all(r["valid"] for r in _told(held.validated(), "bundle")))
    invalid = _invalid(held)
    if args.command == "hash":
        _told(held.hashes(), "bundle")
        return invalid
    rounded = held.similar(args.threshold).select("a", "b", *[F.bround(c, 4).alias(c) for c in ("instruction_similarity", "solution_similarity", "similarity")])
    return int(bool(_told(rounded, "a", "b")) or invalid)


def _invalid(held: Bundles) -> int:
    bad = held.validated().where("not valid").collect()
    for r in bad:
        print(f"{r.bundle}: {len(r.issues)} issues, the first: {r.issues[0].message}", file=sys.stderr)
    return int(bool(bad))


def _cache(args, step: str, spark: SparkSession, store: ObjectStore) -> int:
    if step == "put":
        held = Bundles(spark, args.paths)
        entries = held.contents()
        _told(store.put_bundles(entries.drop("size"), merkle.roots(entries, "sparkloom-bundle/v1"), TREE_TAG), "bundle")
        return _invalid(held)
    if step == "has":
        return int(not all(r.get("held") for r in _told(store.has(spark.createDataFrame([(k,) for k in args.keys], "key string")))))
    if step == "gc":
        size = spark.range(1).select(parse_size(F.lit(args.max_size)).alias("n")).first()["n"]
        if size is None:
            print(f"not a size: {args.max_size}", file=sys.stderr)
            return 2
        print(json.dumps(store.gc(size)))
        return 0
    found = store.get(spark.createDataFrame([(args.key,)], "key string")).first()
    if found is None or found.status != "found":
        print(f"{args.key}: {found.status if found else 'not a key'}", file=sys.stderr)
        return 1
    if args.output:
        with open(args.output, "wb") as out:
            out.write(found.data)
    else:
        sys.stdout.buffer.write(bytes(found.data))
    return 0


def _ledger(args, step: str, spark: SparkSession, book: Ledger) -> int:
    if step == "init":
        print(book.migrate())
        return 0
    if book.revision() is None:
        book.migrate()
    if step in ("register", "check", "revise"):
        held = Bundles(spark, args.paths)
        batch = held.submissions(getattr(args, "actor", ""))
        if step == "register":
            done, good = book.register(batch, "ordinal", args.threshold, args.allow_near_dup), "registered"
        elif step == "revise":
            done, good = book.revise(batch, "ordinal"), "ok"
        else:
            done, good = book.check(batch, args.threshold), "ok"
        return int(any(r["status"] != good for r in _told(done, "slug")) or _invalid(held))
    if step == "status":
        return int(not _told(book.get(args.slug)))
    if step == "transition":
        move = spark.createDataFrame([(args.slug, args.target, args.actor, args.note, 0)], "slug string, to_status string, actor string, note string, k int")
        return int(any(r["status"] != "moved" for r in _told(book.transition(move, "k"))))
    if step == "history":
        _told(book.history(args.slug))
        return 0
    return int(not all(r["ok"] for r in _told(book.verify())))


if __name__ == "__main__":
    sys.exit(main())
