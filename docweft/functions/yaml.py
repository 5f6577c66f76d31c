"""YAML as columns: values by path from front matter and whole files.

The reader is a fold over lines with a stack of indentations: maps, lists, their nesting in either order, block and folded
scalars, quoted and plain scalars of one line, flow lists and maps, comments, and the marks of documents. It works on a text at a time
in Arrow batches, as a line's place depends on all lines before it.

Defined results: null and empty texts are an empty map. A repeated key keeps its last value;
keys are texts. Anchors (`&`, `*`), tags
(`!`), tabs as indentation and what is no YAML of this kind are faults, never guesses: the value is null and the fault
says the line. Plain scalars are typed as
version 1.1 says (null; true, yes, on and their opposites; integers and decimals in base ten), all others are text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key at the start of a line: quoted, or plain up to a colon that white space or the line's end follows.
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>'"%@`\[\]{},-][^#]*?|-[^\s#][^#]*?|[^\s#&*!|>'"%@`\[\]{},-]):(?=\s|$)""")
WHOLE = re.compile(r"[-+]?(?:0|[1-9]\d*)\Z")
DECIMAL = re.compile(r"[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]\d+)?\Z")
WORDS = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False}
STEP = re.compile(r"[^.\[\]]+|\[\d+\]")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}
FOUND = T.StructType([T.StructField("value", T.StringType()), T.StructField("fault", T.StringType())])
PATHS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


class Fault(ValueError):
    pass


def scalar(text: str) -> object:
    """A plain or quoted scalar, or a flow list or map, without what surrounds it."""
    value, at = _flow(text, 0, top=True)
    if text[at:].strip():
        raise Fault(f"unexpected {text[at:].strip()[:20]}")
    return value


def _flow(text: str, at: int, top: bool = False) -> tuple[object, int]:
    at += len(text[at:]) - len(text[at:].lstrip())
    start = text[at : at + 1]
    if start in ("&", "*", "!", "%", "@", "`"):
        raise Fault(f"unknown sign {start}")
    if start == '"':
        found = re.compile(r'"((?:[^"\\]|\\.)*)"').match(text, at)
        if not found:
            raise Fault("open quotation")
        return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else ESCAPES.get(m[2], m[2]), found[1]), found.end()
    if start == "'":
        found = re.compile(r"'((?:[^']|'')*)'").match(text, at)
        if not found:
            raise Fault("open quotation")
        return found[1].replace("''", "'"), found.end()
    if start == "[":
        return _items(text, at + 1)
    if start == "{":
        return _pairs(text, at + 1)
    found = re.compile(r".*\Z" if top else r"[^,\[\]{}]*").match(text, at)
    return _plain(found[0].strip()), found.end()


def _items(text: str, at: int) -> tuple[list, int]:
    out = []
    while True:
        at += len(text[at:]) - len(text[at:].lstrip())
        if text[at : at + 1] == "]":
            return out, at + 1
        value, at = _flow(text, at)
        out.append(value)
        at = _next(text, at, "]")


def _pairs(text: str, at: int) -> tuple[dict, int]:
    out = {}
    while True:
        at += len(text[at:]) - len(text[at:].lstrip())
        if text[at : at + 1] == "}":
            return out, at + 1
        found = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,:\[\]{}]+?)\s*:\s*""").match(text, at)
        if not found:
            raise Fault("a flow map without a key")
        name = str(_flow(found[1], 0)[0]) if found[1][0] in "\"'" else found[1]
        out[name], at = _flow(text, found.end())
        at = _next(text, at, "}")


def _next(text: str, at: int, end: str) -> int:
    """The place behind a comma, or that of the end."""
    at += len(text[at:]) - len(text[at:].lstrip())
    if text[at : at + 1] == ",":
        return at + 1
    if text[at : at + 1] != end:
        raise Fault(f"missing {end}")
    return at


def _plain(text: str) -> object:
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in WORDS and text in (text.lower(), text.upper(), text.title()):
        return WORDS[text.lower()]
    if ": " in text or text.endswith(":"):
        raise Fault("a key within a value")
    if WHOLE.match(text):
        return int(text)
    if DECIMAL.match(text):
        return float(text)
    return text


def _bare(line: str) -> str:
    """A line without its comment: from a # at the start or behind white space, outside quotations."""
    if "#" not in line:
        return line.rstrip()
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def loaded(text: str | None) -> object:
    """A text's maps, lists and scalars; raises Fault with the line's number."""
    lines = (text or "").removeprefix("﻿").splitlines()
    root: list = [None]
    # What is open, outermost first: (indentation, the container or None while its kind is unknown, where it hangs, in a map?).
    stack: list[tuple] = [(-1, None, (root, 0), False)]
    n = 0

    def put(value: object) -> None:
        """Gives the innermost open place its value."""
        box, at = stack[-1][2]
        box[at] = value
        if len(stack) > 1:
            stack.pop()
        else:
            stack[0] = (-1, root, (root, 0), False)

    def opened(indent: int, kind: type) -> object:
        """The container that a line of this indentation belongs to."""
        while True:
            depth, box, (outer, at), keyed = stack[-1]
            if box is None and (indent > depth or kind is list and keyed and indent == depth):
                outer[at] = kind()
                stack[-1] = (indent, outer[at], (outer, at), keyed)
                return outer[at]
            if box is not None and indent == depth and isinstance(box, kind):
                return box
            if box is not None and indent > depth or len(stack) == 1:
                raise Fault("indentation does not fit")
            stack.pop()

    while n < len(lines):
        line = _bare(lines[n])
        try:
            if not line.strip() or n == 0 and line == "---":
                n += 1
                continue
            if line in ("---", "..."):
                break
            indent, rest = len(line) - len(line.lstrip(" ")), line.lstrip(" ")
            if rest.startswith("\t"):
                raise Fault("tab as indentation")
            own = False
            while rest == "-" or rest.startswith("- "):
                items = opened(indent, list)
                items.append(None)
                stack.append((indent, None, (items, len(items) - 1), False))
                inner = rest[1:].lstrip(" ")
                indent, rest, own = indent + len(rest) - len(inner), inner, True
            key = KEY.match(rest)
            if key:
                pairs = opened(indent, dict)
                name = str(scalar(key[1])) if key[1][0] in "\"'" else key[1].strip()
                pairs[name] = None
                stack.append((indent, None, (pairs, name), True))
                rest, own = rest[key.end() :].strip(), True
            if not rest:
                n += 1
                continue
            if not own and (stack[-1][1] is not None or indent <= stack[-1][0]):
                raise Fault("neither key nor item")
            if rest[0] in "|>":
                value, n = _block(lines, n + 1, stack[-1][0], rest)
                put(value)
                continue
            while rest[0] in "[{" and n + 1 < len(lines) and not _closed(rest):
                n += 1
                rest += " " + _bare(lines[n]).strip()
            put(scalar(rest))
        except Fault as e:
            raise Fault(f"line {n + 1}: {e}") from None
        n += 1
    return root[0]


def _closed(text: str) -> bool:
    bare = re.sub(r"""(?<![^\s,:\[{])("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')""", "", text)
    if re.search(r"""(?<![^\s,:\[{])["']""", bare):
        raise Fault("open quotation")
    return bare.count("[") + bare.count("{") <= bare.count("]") + bare.count("}")


def _block(lines: list[str], n: int, indent: int, head: str) -> tuple[str, int]:
    """A block scalar's text and the line behind it; head: its sign with indentation and chomping marks."""
    if not re.match(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)\Z", head):
        raise Fault("a block scalar's head")
    own: list[str] = []
    depth = next((max(indent, 0) + int(c) for c in head if c.isdigit()), None)
    while n < len(lines):
        line = lines[n]
        inside = len(line) - len(line.lstrip(" "))
        if line.strip():
            depth = inside if depth is None else depth
            if inside < depth or inside <= indent:
                break
        own.append(line[depth or 0 :] if line.strip() else "")
        n += 1
    kept = len(own)
    while kept and not own[kept - 1]:
        kept -= 1
    body, tail = own[:kept], len(own) - kept
    if head[0] == "|":
        text = "\n".join(body)
    else:
        text, blank, before = "", 0, False
        for k, line in enumerate(body):
            if not line:
                blank += 1
                continue
            deep = line[0] == " "
            if k:
                text += "\n" * (blank + (deep or before)) if blank or deep or before else " "
            text, blank, before = text + line, 0, deep
    if "-" in head or not body:
        return text, n
    return text + "\n" * (1 + tail if "+" in head else 1), n


def at(value: object, path: str) -> object:
    """What lies at a path like `a.b[2].c`; raises Fault where it leads nowhere."""
    steps = STEP.findall(path)
    if "".join(steps) != path.replace(".", "") or not steps:
        raise Fault(f"no path {path}")
    for step in steps:
        try:
            value = value[int(step[1:-1])] if step[0] == "[" else value[step] if isinstance(value, dict) else [][0]
        except (KeyError, IndexError, TypeError):
            raise Fault(f"missing {path}") from None
    return value


def shown(value: object) -> str | None:
    """A scalar as its text, maps and lists as JSON."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def flat(value: object, path: str = "") -> Iterator[tuple[str, str | None]]:
    """(path, value) of every scalar, and of empty maps and lists, in order."""
    if isinstance(value, (dict, list)) and value:
        for key, inner in value.items() if isinstance(value, dict) else enumerate(value):
            yield from flat(inner, f"{path}[{key}]" if isinstance(value, list) else f"{path}.{key}" if path else key)
    else:
        yield path, shown(value)


@F.pandas_udf(FOUND)
def _found(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
    rows = []
    for text, path in zip(texts, paths, strict=True):
        try:
            rows.append((None, "no path") if path is None else (shown(at(loaded(text), path)), None))
        except Fault as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["value", "fault"])


@F.pandas_udf(PATHS)
def _paths(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        try:
            value = loaded(text)
            out.append([{"path": p, "value": v} for p, v in flat(value)] if value not in (None, {}, []) else [])
        except Fault:
            out.append(None)
    return pd.Series(out)


def found(text: Column, path: Column) -> Column:
    """struct(value, fault): what a YAML text has at a path like `a.b[2].c`; a map or list as JSON, a missing one as fault."""
    return _found(text, path)


def paths(text: Column) -> Column:
    """array of (path, value) of all scalars of a YAML text, in order; null if it is no YAML."""
    return _paths(text)
