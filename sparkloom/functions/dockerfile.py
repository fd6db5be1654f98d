"""Reading of Dockerfiles: instructions with their places, build arguments, image references."""

from __future__ import annotations

import re
import shlex
from typing import NamedTuple

from . import text

_HEREDOC = re.compile(r"(?<!<)<<-?(?!<)\s*(['\"]?)(\w+)\1")
_VARIABLE = re.compile(r"\$(?:(\w+)|\{(\w+)(?:(:?)([-+])([^}]*))?\})")


class Instruction(NamedTuple):
    keyword: str
    value: str
    line: int
    column: int
    #: Length of the part of value on the first line; beyond it only the instruction's own column is known.
    here: int

    def at(self, offset: int) -> int:
        return self.column + (offset if offset < self.here else 0)


def instructions(source: str) -> list[Instruction]:
    """Instructions in order. Comments, blank lines and heredoc bodies are none; the escape directive is obeyed."""
    lines = list(enumerate(re.split(r"\r\n|\r|\n", source), 1))
    lines.reverse()  # a stack
    escape = "\\"
    while lines and (directive := re.fullmatch(r"\s*#\s*([A-Za-z]+)\s*=\s*(\S+)\s*", lines[-1][1])):
        lines.pop()
        if directive[1].lower() == "escape" and directive[2] in "\\`":
            escape = directive[2]
    out = []
    while lines:
        number, line = lines.pop()
        head = re.match(r"\s*([^\s#]\S*)\s*", line)
        if not head:
            continue
        rest, parts = line[head.end() :], []
        while True:
            bare = rest.rstrip()
            goes_on = bare.endswith(escape)
            parts.append(bare[:-1] if goes_on else rest)
            while goes_on and lines and re.match(r"\s*(#|$)", lines[-1][1]):
                lines.pop()
            if not goes_on or not lines:
                break
            rest = lines.pop()[1]
        made = Instruction(head[1].upper(), "".join(parts).rstrip(), number, head.end() + 1, len(parts[0]))
        out.append(made)
        if made.keyword in ("RUN", "COPY", "ADD"):
            for _, word in _HEREDOC.findall(made.value):
                while lines and lines.pop()[1].strip() != word:
                    pass
    return out


def flags(value: str, name: str) -> list[tuple[str, int]]:
    """(value, offset) of leading --name=value options."""
    leading = re.match(r"(?:\s*--\S+)*", value)[0]
    return [(m[1], m.start(1)) for m in re.finditer(rf"(?<!\S)--{name}=(\S*)", leading)]


def base(value: str) -> tuple[str, int, str | None] | None:
    """(image, offset, stage name) of a FROM; None without an image."""
    found = re.match(r"(?:\s*--\S+)*\s*(\S+)(?:\s+[aA][sS]\s+(\S+))?", value)
    return (found[1], found.start(1), found[2]) if found and not found[1].startswith("--") else None


def arguments(value: str) -> dict[str, str | None]:
    try:
        words = shlex.split(value)
    except ValueError:
        words = value.split()
    return {name: (default if eq else None) for name, eq, default in (w.partition("=") for w in words)}


def expanded(source: str, values: dict[str, str | None]) -> tuple[str, list[str]]:
    """The text with variables put in, and the names that have no value."""
    missing: list[str] = []

    def put(m: re.Match) -> str:
        name, colon, sign, word = m[1] or m[2], m[3], m[4], m[5]
        value = values.get(name)
        if not sign:
            if value is None:
                missing.append(name)
            return value or ""
        present = value is not None and not (colon and value == "")
        if present and sign == "-":
            return value
        if not present and sign == "+":
            return ""
        other, more = expanded(word, values)
        missing.extend(more)
        return other

    return _VARIABLE.sub(put, source), missing


def unpinned(source: str, build_args: dict[str, str], section: str | None) -> list[tuple[int, int, str]]:
    """(line, column, message) of the images that no digest pins."""
    outer: dict[str, str | None] = {}
    inner: dict[str, str | None] | None = None
    stages: set[str] = set()
    out = []

    def judge(raw: str, values: dict, what: str) -> str | None:
        name, missing = expanded(raw, values)
        if missing:
            place = f" or in [{section}].build_args" if section else ""
            return f"{what} '{raw}' depends on build arg {', '.join(dict.fromkeys(missing))}, which has no value in the Dockerfile{place}, so its digest cannot be checked"
        if name.lower() in stages | {"scratch"}:
            return None
        try:
            digest = text.parse_image(name)[3]
        except ValueError as wrong:
            return f"{what} '{name}' is not a valid image reference: {wrong}"
        if digest is not None:
            return None
        return f"{what} '{name}'" + (f" (resolved from '{raw}')" if raw != name else "") + " is not pinned by digest"

    for step in instructions(source):
        images: list[tuple[str, int, dict, str]] = []
        stage = None
        if step.keyword == "ARG":
            (outer if inner is None else inner).update(arguments(step.value))
        elif step.keyword == "FROM":
            inner = {}
            if named := base(step.value):
                images.append((named[0], named[1], {**outer, **build_args}, "base image"))
                stage = named[2]
        elif step.keyword in ("COPY", "ADD"):
            values = {**outer, **(inner or {}), **build_args}
            images += [(v, at, values, "COPY --from image") for v, at in flags(step.value, "from") if not v.isdigit() and v.lower() not in stages]
        for raw, offset, values, what in images:
            if message := judge(raw, values, what):
                out.append((step.line, step.at(offset), message))
        if stage:
            stages.add(stage.lower())
    return out
