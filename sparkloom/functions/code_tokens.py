"""Tokens of Python source that survive renaming, comments and layout; a plainer reading where it does not parse."""

from __future__ import annotations

import io
import keyword
import re
import tokenize

#: Public names of Python 3.12's built-ins, so that any interpreter agrees. Words in small letters, then exceptions and warnings.
_FUNCTIONS = """
abs aiter all anext any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex copyright credits delattr dict dir
divmod enumerate eval exec exit filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len
license list locals map max memoryview min next object oct open ord pow print property quit range repr reversed round set setattr slice sorted
staticmethod str sum super tuple type vars zip Ellipsis False None NotImplemented True
"""
_ERRORS = """
Arithmetic Assertion Attribute BlockingIO BrokenPipe Buffer ChildProcess ConnectionAborted Connection ConnectionRefused ConnectionReset EOF
Environment FileExists FileNotFound FloatingPoint IO Import Indentation Index Interrupted IsADirectory Key Lookup Memory ModuleNotFound Name
NotADirectory NotImplemented OS Overflow Permission ProcessLookup Recursion Reference Runtime Syntax System Tab Timeout Type UnboundLocal
UnicodeDecode UnicodeEncode Unicode UnicodeTranslate Value ZeroDivision
"""
_WARNINGS = "Bytes Deprecation Encoding Future Import PendingDeprecation Resource Runtime Syntax Unicode User"
_OTHERS = "BaseException BaseExceptionGroup Exception ExceptionGroup GeneratorExit KeyboardInterrupt StopAsyncIteration StopIteration SystemExit Warning"
BUILTINS = frozenset([*_FUNCTIONS.split(), *(f"{e}Error" for e in _ERRORS.split()), *(f"{w}Warning" for w in _WARNINGS.split()), *_OTHERS.split()])
KEPT = (frozenset(keyword.kwlist) | frozenset(keyword.softkwlist) | BUILTINS) - {"_"}
#: What is written for a token by its kind: nothing, the same word for all, or a form of its text; a statement may begin behind _BREAKS.
_BREAKS = frozenset({tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT})
_UNSEEN = _BREAKS | {tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.ENDMARKER}
_TEXT_KINDS = {"STRING": "STR", "FSTRING_START": "STR", "TSTRING_START": "STR", "FSTRING_MIDDLE": None, "FSTRING_END": None, "TSTRING_MIDDLE": None, "TSTRING_END": None}
_COMMENT = re.compile(r"(?:^|\s)(?:#|//).*$", re.M)
_PLAIN = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|([A-Za-z_]\w*)|\d[\w.]*|\S""")


def _numbered():
    """Names -> ID0, ID1, ... by first use; kept ones stay."""
    known: dict[str, str] = {}
    return lambda name: name if name in KEPT else known.setdefault(name, f"ID{len(known)}")


def code_tokens(source: str) -> list[str]:
    """Python's tokens without comments, layout and strings that begin a statement; names numbered, other strings as STR."""
    try:
        found = list(tokenize.generate_tokens(io.StringIO(source).readline))
    except (tokenize.TokenError, SyntaxError):
        named = _numbered()
        return ["STR" if text else named(name) if name else m[0].lower() for m in _PLAIN.finditer(_COMMENT.sub("", source)) for text, name in [m.groups()]]
    named, out, begins = _numbered(), [], True
    for token in found:
        if token.type in _UNSEEN:
            begins = begins or token.type in _BREAKS
            continue
        kind = tokenize.tok_name[token.type]
        if kind == "NAME":
            out.append(named(token.string))
        elif kind in _TEXT_KINDS:
            if _TEXT_KINDS[kind] and not (begins and kind == "STRING"):
                out.append(_TEXT_KINDS[kind])
        else:
            out.append(token.string.lower() if kind == "NUMBER" else token.string)
        begins = False
    return out


def code_shingles(sources: list[str], size: int = 5) -> set[str]:
    """Runs of `size` tokens over all files, each file numbered by itself; a shorter file is one run."""
    out: set[str] = set()
    for source in sources:
        tokens = code_tokens(source)
        if tokens:
            out.update(" ".join(tokens[k : k + size]) for k in range(max(1, len(tokens) - size + 1)))
    return out
