"""Rows out of damaged JSON replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a scan stops at: a string, closed or cut off by the end of the text, a bracket or a comma.
_MARK = re.compile(r'"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)|[{}\[\],]', re.S)
_CLOSING = {"{": "}", "[": "]"}
_AROUND = re.compile(r"(?s)<think>.*?</think>|<\|thinking\|>.*?<\|/thinking\|>|```(?:json)?")
#: A last member that has no value yet, or only a part of a word or number that is none.
_KEY_ONLY = re.compile(r'\s*"(?:[^"\\]++|\\.)*+"\s*:?\s*\Z', re.S)
_WORD = re.compile(r"(.*?[:\[,{]|)(\s*)([^\s\":\[\]{},]+)\s*\Z", re.S)


class _Open:
    """An object or list being read: its closing bracket, where the text written so far stood when it began, and when its last
    whole member ended; whether anything is nested in it."""

    __slots__ = ("close", "flat", "safe", "start")

    def __init__(self, close: str, start: int):
        self.close, self.start, self.safe, self.flat = close, start, start + 1, True


def _no_constant(name: str) -> None:
    raise ValueError(name)


_decoder = json.JSONDecoder(strict=False, parse_constant=_no_constant)
_encoded = json.JSONEncoder(ensure_ascii=False).encode


def _loaded(text: str) -> object:
    if text[:1] not in '{["-0123456789tfn' and not text[:1].isspace():
        return None
    try:
        return _decoder.decode(text)
    except (ValueError, RecursionError):
        return None


def scanned(text: str) -> list[tuple[object, bool]]:
    """The outermost objects and lists of a damaged text, and whether each was closed, in one pass that knows depth and strings.

    Commas before a closing bracket go; a bracket that closes an outer one closes those within as well, one that closes nothing is
    left out; at the end of the text what is open is closed, a string kept as far as it goes, a member without a value left out.
    Where a value cannot be read even so, those of its objects are given that hold no other and can.
    """
    out: list[tuple[object, bool]] = []
    parts: list[str] = []
    size = at = 0
    stack: list[_Open] = []
    flat: list[str] = []

    def put(piece: str) -> None:
        nonlocal size
        parts.append(piece)
        size += len(piece)

    def cut(to: int) -> None:
        nonlocal size
        while size > to:
            last = parts.pop()
            size -= len(last)
            if size < to:
                put(last[: to - size])

    def tail(since: int) -> str:
        found, n = [], size
        for p in reversed(parts):
            if n <= since:
                break
            n -= len(p)
            found.append(p)
        return "".join(reversed(found))[max(0, since - n) :]

    def closed(whole: bool) -> None:
        top = stack.pop()
        own = tail(top.safe)
        if not own.strip(" \t\r\n,"):
            cut(top.safe)
        put(top.close)
        if top.flat and top.close == "}":
            flat.append(tail(top.start))
        if stack:
            stack[-1].flat = False
            stack[-1].safe = size
        else:
            value = _loaded("".join(parts))
            if value is not None:
                out.append((value, whole))
            else:
                out.extend((v, whole) for f in flat if (v := _loaded(f)) is not None)
            cut(0)
            flat.clear()

    for m in _MARK.finditer(text):
        mark = m[0]
        if stack:
            put(text[at : m.start()])
        at = m.end()
        if mark in "{[":
            stack.append(_Open(_CLOSING[mark], size))
            put(mark)
        elif not stack:
            continue
        elif mark in "}]":
            if any(o.close == mark for o in stack):
                while stack[-1].close != mark:
                    closed(True)
                closed(True)
        elif mark == ",":
            stack[-1].safe = size
            put(mark)
        else:
            whole = len(mark) > 1 and mark.endswith('"') and (len(mark) - len(mark[:-1].rstrip("\\"))) % 2 == 1
            put(mark if whole else mark.rstrip("\\") + '"')
    if stack:
        put(text[at:])
    while stack:
        own = tail(stack[-1].safe).lstrip(" \t\r\n,")
        if stack[-1].close == "}" and _KEY_ONLY.match(own) or (w := _WORD.match(own)) and _loaded(w[3]) is None and w[3] != "null":
            cut(stack[-1].safe)
        closed(False)
    return out


def recovered(reply: str | None, fewest_keys: int = 2) -> list[str]:
    """What objects gives, of one reply."""
    text = (_AROUND.sub("", reply) if reply and ("<" in reply or "`" in reply) else reply or "").strip()
    if not text:
        return []
    dicts = lambda v: [x for x in v if isinstance(x, dict)]
    listed = lambda d: next((v for v in d.values() if isinstance(v, list)), None)
    value = _loaded(text)
    if isinstance(value, list):
        found = dicts(value)
    elif isinstance(value, dict):
        found = [value] if (inner := listed(value)) is None else dicts(inner)
    else:
        values = scanned(text)
        held = next((v for v, whole in values if whole and isinstance(v, list) and dicts(v)), None)
        if held is not None:
            found = dicts(held)
        else:
            found = []
            for v, whole in values:
                inner = listed(v) if isinstance(v, dict) and not whole else v if isinstance(v, list) else None
                found += dicts(inner) if inner is not None else [v]
            found = [d for d in found if len(d) >= fewest_keys]
    return [_encoded(d) for d in found]

def bare(reply: Column) -> Column:
    """A reply without reasoning blocks and code fences."""
    c = F.regexp_replace(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"(?s)<\|thinking\|>.*?<\|/thinking\|>", "")
    return F.regexp_replace(F.regexp_replace(c, r"```(?:json)?", ""), r"^\s+|\s+$", "")


def _listed(c: Column) -> Column:
    """The objects of a JSON list, as JSON texts; null if the text is no list."""
    whole = F.when(F.try_variant_get(F.try_parse_json(c), "$[0]", "variant").isNotNull(), F.from_json(c, "array<string>"))
    return F.filter(whole, lambda o: F.ltrim(o).startswith("{"))


def objects(reply: Column, fewest_keys: int = 2) -> Column:
    """The objects of a reply, as JSON texts: of the list it is, of the first list within the object it is, or that object; else of the
    first whole list it holds; else of what can be picked out of a broken one (see scanned), those of at least so many keys. Nested
    objects stay whole, however deep. None, and for a blank or null reply, an empty array. Runs in Arrow batches, each reply read once."""

    @F.pandas_udf("array<string>")
    def run(replies: pd.Series) -> pd.Series:
        return replies.map(lambda r: recovered(r, fewest_keys))

    return run(reply)


def only_list(reply: Column) -> Column:
    """The objects of the list that a reply is or holds, as JSON texts; a reply without a sound list gives none."""
    c = F.coalesce(bare(reply), F.lit(""))
    held = F.regexp_extract(c, r"(?s)(\[\s*\{.*\}\s*\])", 1)
    return F.coalesce(_listed(F.when(held != "", held).otherwise(c)), F.array().cast("array<string>"))


def records(reply: Column, schema: str, fewest_keys: int = 2) -> Column:
    """The objects as structs of a DDL schema."""
    return F.transform(objects(reply, fewest_keys), lambda o: F.from_json(o, schema))
