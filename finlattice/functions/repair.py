"""Mending JSON that a model wrote: a reader that takes tokens as they come and never fails inside a value."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*", re.S)
_BARE = re.compile(r"""[^\s{}\[\],:"]+(?:[ \t]+[^\s{}\[\],:"]+)*""")
#: What may follow the quote that ends a string: a delimiter, the end, a line's end, or the next value after a lost comma.
_AFTER = re.compile(r"""\s*(?:[,:\]}]|\Z|\n)|\s+(?:["{\[]|-?\d|(?:true|false|null)\b)""")
#: The end of a string's text where a lost quote let it run into the next name.
_RUN_ON = re.compile(r"""\s*,\s*"[^"]*\Z""")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_ESCAPES = {**{c: c for c in "\"\\/'"}, "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_LITERALS = {"true": True, "false": False, "null": None, "none": None, "nan": None, "undefined": None}
_QUOTES = {'"': '"', "'": "'", "\u201c": "\u201d"}


def _string(text: str, at: int, is_value: bool) -> tuple[str, int]:
    """(value, place after it) of the string whose opening quote stands at `at`.

    A quote inside that nothing fitting follows belongs to the string. One that never ends stops before the delimiters at
    the end of its line, or of the text; a value that ran on to the colon of the next name stops before that name.
    """
    close, out, k = _QUOTES[text[at]], [], at + 1
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            out.append(text[k : k + 2])
            k += 2
            continue
        if c == close and _AFTER.match(text, k + 1):
            if is_value and text[k + 1 :].lstrip()[:1] == ":" and (over := _RUN_ON.search("".join(out))):
                return _unescaped("".join(out)[: over.start()]), at + 1 + over.start()
            return _unescaped("".join(out)), k + 1
        if c == "\n":
            line = "".join(out).rstrip()
            if line and line[-1] in ",}]":
                break
        out.append(c)
        k += 1
    kept = "".join(out).rstrip()
    value = kept.rstrip(",]} \t\r\n")
    return _unescaped(value), k - (len("".join(out)) - len(value))


def _unescaped(text: str) -> str:
    """Escapes as JSON has them, and \\'; a backslash before anything else stays."""
    out = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[0]), text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _tokens(text: str, at: int, held: list[_Open]) -> Iterator[tuple[str, Any]]:
    """("mark", one of {}[],:) and ("value", string, number or literal) in turn. held: what is open by then."""
    while True:
        at = _BLANK.match(text, at).end()
        if at >= len(text):
            return
        c = text[at]
        if c in "{}[],:":
            yield "mark", c
            at += 1
        elif c in _QUOTES:
            value, at = _string(text, at, bool(held) and held[-1].colon)
            yield "value", value
        elif (bare := _BARE.match(text, at)) is None:
            at += 1  # a stray quote
        else:
            word, at = bare[0], bare.end()
            try:
                yield "value", _LITERALS[word.lower()] if word.lower() in _LITERALS else json.loads(word)
            except ValueError:
                yield "value", word


class _Open:
    """An object or array that isn't closed yet."""

    def __init__(self, is_object: bool):
        self.value: Any = {} if is_object else []
        self.is_object, self.key, self.colon = is_object, None, False

    def add(self, value: Any) -> None:
        if not self.is_object:
            self.value.append(value)
        elif self.key is None:
            if isinstance(value, (dict, list)):
                return  # a value without a name
            self.key, self.colon = str(value), False
        elif not self.colon and isinstance(value, str):  # two strings without a colon: the first had lost its value
            self.settle()
            self.add(value)
        else:
            self.value[self.key] = value
            self.key, self.colon = None, False

    def settle(self) -> None:
        """What stands before a comma or a bracket is done; a name without a value has null."""
        if self.is_object and self.key is not None:
            self.value[self.key] = None
            self.key, self.colon = None, False


def parse(text: str) -> Any:
    """The first object in the text, or else the first array, mended; None where there is neither.

    Mended are: text around it, lost commas, colons, quotes and closing brackets, commas too many, brackets that don't
    match, single quotes, names and values without quotes, comments, line ends and quotes inside strings.
    """
    start = text.find("{")
    start = text.find("[") if start < 0 else start
    if start < 0:
        return None
    held: list[_Open] = []
    for kind, token in _tokens(text, start, held):
        if kind == "value":
            held[-1].add(token)
        elif token in "{[":
            held.append(_Open(token == "{"))
        elif token == ":":
            top = held[-1]
            if not top.is_object and len(held) > 1 and held[-2].is_object and top.value and isinstance(top.value[-1], str):
                name = top.value.pop()  # the bracket of a list was lost before the next name
                held.pop()
                held[-1].add(top.value)
                held[-1].add(name)
            held[-1].colon = held[-1].key is not None
        elif token == ",":
            held[-1].settle()
        else:
            is_object = token == "}"
            if all(o.is_object != is_object for o in held):
                continue  # closes nothing
            done = False
            while not done:
                done = held[-1].is_object == is_object
                top = held.pop()
                top.settle()
                if not held:
                    return top.value
                held[-1].add(top.value)
    while len(held) > 1:
        top = held.pop()
        top.settle()
        held[-1].add(top.value)
    held[0].settle()
    return held[0].value


@F.pandas_udf(StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """Valid JSON for texts that aren't; null where nothing like JSON is in them."""
    out = [None if t is None else parse(t) for t in texts]
    return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False) for v in out], dtype=object)
