"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"
SEMVER = (
    r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)"
    r"(-(0|[1-9][0-9]*|[0-9]*[a-zA-Z-][0-9a-zA-Z-]*)(\.(0|[1-9][0-9]*|[0-9]*[a-zA-Z-][0-9a-zA-Z-]*))*)?"
    r"(\+[0-9a-zA-Z-]+(\.[0-9a-zA-Z-]+)*)?$"
)
PLATFORM = r"^[a-z0-9]+/[a-z0-9_]+(/[a-z0-9]+)?$"
SELECTOR = r"^(ALL|[A-Z]{1,8}[0-9]{0,4})$"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
#: Parts of an image reference: a registry's host, a path, a tag, a digest; and how long a name (host and path) may be.
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
IMAGE_DOMAIN = rf"^{_HOST}(?:\.{_HOST})*(?::[0-9]+)?$"
_COMPONENT = r"[a-z0-9]+(?:(?:[._]|__|-+)[a-z0-9]+)*"
IMAGE_PATH = rf"^{_COMPONENT}(?:/{_COMPONENT})*$"
IMAGE_TAG = r"^[A-Za-z0-9_][A-Za-z0-9_.-]{0,127}$"
IMAGE_DIGEST = r"^sha256:[0-9a-f]{64}$"
IMAGE_NAME = 255
#: A path is left out if one of its parts has such a name (* is any run of characters).
IGNORED_NAMES = (
    ".DS_Store", "._*", "Thumbs.db", "desktop.ini", ".git", ".hg", ".svn", "__pycache__", "*.pyc", "*.pyo", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".ipynb_checkpoints",
)
IGNORED = "(?s)^(?:" + "|".join(n.replace(".", r"\.").replace("*", ".*") for n in IGNORED_NAMES) + ")$"


def unix_newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n|\r", "\n")


def is_binary(content: Column) -> Column:
    """Bytes with a NUL are binary."""
    return F.contains(content, F.unhex(F.lit("00")))


def split_lines(text: Column) -> Column:
    """Lines ended by CRLF, CR or LF; an empty last line is none."""
    lines = F.split(text, "\r\n|\r|\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def fold_id(name: Column) -> Column:
    """Case and separators do not tell ids apart."""
    return F.regexp_replace(F.lower(name), r"[\s_.\-]+", "")


def is_slug(value: Column, least: int = 3, most: int = 64) -> Column:
    return F.length(value).between(least, most) & value.rlike(SLUG)


def is_semver(value: Column) -> Column:
    return value.rlike(SEMVER)


def is_title(value: Column) -> Column:
    return F.length(value).between(3, 120) & (value == F.trim(value)) & ~value.rlike(r"[\r\n]")


def tags_ok(tags: Column) -> Column:
    """At most 16 distinct tags, each a slug of 2 to 32 characters."""
    return (F.size(tags) <= 16) & (F.size(F.array_distinct(tags)) == F.size(tags)) & F.forall(tags, lambda t: is_slug(t, 2, 32))


_AS_DOMAIN = r"(?:localhost/|[^/@]*[.:][^/@]*/)"
IMAGE = (
    rf"^(?=[^@]{{1,{IMAGE_NAME}}}?(?::[^:/@]*)?(?:@.*)?$)(?:(?={_AS_DOMAIN})({IMAGE_DOMAIN[1:-1]})/|(?!{_AS_DOMAIN}))"
    rf"({IMAGE_PATH[1:-1]})(?::({IMAGE_TAG[1:-1]}))?(?:@({IMAGE_DIGEST[1:-1]}))?\z"
)


def image_ref(value: Column) -> Column:
    """struct(domain, path, tag, digest) of an image reference, null if it is none.

    The digest follows the first @, the tag the last colon behind the last slash. The first part of the rest, whose length is
    bounded, is a domain if it has a dot or a colon or is localhost.
    """
    part = lambda k: F.regexp_extract(value, IMAGE, k)
    some = lambda k: F.nullif(part(k), F.lit(""))
    return F.when(value.rlike(IMAGE), F.struct(some(1).alias("domain"), part(2).alias("path"), some(3).alias("tag"), some(4).alias("digest")))


def parse_image(value: str) -> tuple[str | None, str, str | None, str | None]:
    """The same of one string; ValueError says what is wrong."""
    if not value or value != value.strip():
        raise ValueError("must be a non-empty image reference without surrounding whitespace")
    rest, at, digest = value.partition("@")
    slash = rest.rfind("/") + 1
    last, colon, tag = rest[slash:].rpartition(":") if ":" in rest[slash:] else (rest[slash:], "", "")
    name = rest[:slash] + last
    first, more, path = name.partition("/")
    real = bool(more) and ("." in first or ":" in first or first == "localhost")
    checks = [
        (at and not _whole(IMAGE_DIGEST, digest), f"digest must be 'sha256:' followed by 64 lowercase hex characters, got {digest!r}"),
        (colon and not _whole(IMAGE_TAG, tag), f"invalid tag {tag!r}: use up to 128 letters, digits, '_', '.' or '-', not starting with '.' or '-'"),
        (not name, "missing repository name"),
        (len(name) > IMAGE_NAME, f"repository name is longer than {IMAGE_NAME} characters"),
        (real and not _whole(IMAGE_DOMAIN, first), f"invalid registry host {first!r}"),
    ]
    checks += [(not _whole(f"^{_COMPONENT}$", c), f"invalid repository path component {c!r}: use lowercase letters and digits joined by '.', '_', '__' or '-'") for c in (path if real else name).split("/")]
    for wrong, said in checks:
        if wrong:
            raise ValueError(said)
    return (first if real else None, path if real else name, tag if colon else None, digest if at else None)


def _whole(pattern: str, value: str) -> bool:
    return re.fullmatch(pattern.strip("^$"), value) is not None


def parse_size(value: Column) -> Column:
    """Bytes of a size such as 512K, 100MB or 2GiB; units are binary; null if it is none."""
    pattern = r"^\s*([0-9]+)\s*([kKmMgGtT]?)(?:[iI]?[bB])?\s*$"
    unit = F.lower(F.regexp_extract(value, pattern, 2))
    factor = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).when(unit == "t", 1 << 40).otherwise(1).cast("long")
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1).cast("long") * factor)


def human_size(size: Column) -> Column:
    """512 B, 1.5 KiB, and so on up to TiB; halves go to the even digit."""
    tenth = lambda n: F.bround(size / float(1 << n), 1)
    out = F.format_string("%.1f TiB", tenth(40))
    for unit, least in (("GiB", 30), ("MiB", 20), ("KiB", 10)):
        out = F.when(size < (1 << (least + 10)), F.format_string(f"%.1f {unit}", tenth(least))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty string."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    total = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / total)
    return F.abs(F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def redacted(value: Column, keep: int = 0) -> Column:
    return F.concat(F.substring(value, 1, keep), F.lit("[redacted, "), F.length(value).cast("string"), F.lit(" chars]"))


def ignored(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.rlike(IGNORED))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of all matches of a pattern, in order; start counts from 1. Null has none."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    step = lambda done, k: F.struct(
        (done["at"] + F.length(F.get(gaps, k)) + F.length(F.get(values, k))).alias("at"),
        F.array_append(done["out"], F.struct((done["at"] + F.length(F.get(gaps, k)) + 1).alias("start"), F.get(values, k).alias("value"))).alias("out"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
    order = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(order, none, step)["out"]


def object_key(value: Column) -> Column:
    """64 hex digits of a key that may be prefixed by its algorithm; null if malformed."""
    bare = F.regexp_replace(value, "^sha256:", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def object_path(key: Column) -> Column:
    """Where an object lies: the first two digits are a folder."""
    return F.concat(F.substring(key, 1, 2), F.lit("/"), F.substring(key, 3, 62))


def finding_fingerprint(code: Column, file: Column, message: Column, occurrence: Column) -> Column:
    joined = F.concat_ws("\0", code, file, message, occurrence.cast("string"))
    return F.substring(F.sha2(joined, 256), 1, 32)


def location(parts: list) -> str:
    """a.b[2].c of the parts of a place in a document."""
    out = ""
    for part in parts:
        out += f"[{part}]" if isinstance(part, int) else ("." if out else "") + str(part)
    return out
