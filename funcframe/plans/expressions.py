"""Constraint expressions: ``a,b&time>=2020-01-01&take(3)`` as projections, selections and operations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from funcframe.model import ModelError

OPERATORS = ("~", ">=", "<=", "==", "=~", "!=~", "!=", ">", "<", "=")
_ID = r"(?!\d)[\w.]+"
_SELECT = re.compile(rf"({_ID})\s*(!=~|=~|!=|>=|<=|==|~|>|<|=)\s*(.*)\Z", re.S)
_CALL = re.compile(r"((?!\d)\w+)\s*\((.*)\)\Z", re.S)
_LIST = re.compile(rf"{_ID}(\s*,\s*{_ID})*\Z")


@dataclass(frozen=True)
class Projection:
    ids: tuple[str, ...]


@dataclass(frozen=True)
class Selection:
    id: str
    op: str
    value: str


@dataclass(frozen=True)
class Operation:
    name: str
    args: tuple


def arguments(text: str) -> tuple:
    """Arguments between commas; lists in parentheses; texts in quotes keep them."""
    out: list = []
    at = 0
    text = text.strip()

    def value():
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text) and text[at] == "(":
            at += 1
            items = []
            while True:
                items.append(value())
                if at >= len(text) or text[at] not in ",)":
                    raise ModelError(f"Failed to parse arguments: {text}")
                at += 1
                if text[at - 1] == ")":
                    break
            while at < len(text) and text[at].isspace():
                at += 1
            return tuple(items)
        m = re.compile(r'"(?:[^"\\]|\\.)*"|[^,()"]*').match(text, at)
        at = m.end()
        got = m[0].strip()
        if not got:
            raise ModelError(f"Failed to parse arguments: {text}")
        while at < len(text) and text[at].isspace():
            at += 1
        return got

    while at < len(text):
        out.append(value())
        if at < len(text):
            if text[at] != ",":
                raise ModelError(f"Failed to parse arguments: {text}")
            at += 1
            if at == len(text):
                raise ModelError(f"Failed to parse arguments: {text}")
    return tuple(out)


def parse(text: str) -> list[Projection | Selection | Operation]:
    """Terms in the order of the text; only the first may be a projection."""
    out: list = []
    for term in filter(None, (t.strip() for t in text.lstrip("&").split("&"))):
        if m := _CALL.match(term):
            out.append(Operation(m[1], arguments(m[2])))
        elif m := _SELECT.match(term):
            if not m[3].strip():
                raise ModelError(f"Failed to parse expression: {term}")
            out.append(Selection(m[1], m[2], m[3].strip()))
        elif _LIST.match(term) and not out:
            out.append(Projection(tuple(re.split(r"\s*,\s*", term))))
        else:
            raise ModelError(f"Failed to parse expression: {term}")
    return out


def pretty(terms: list[Projection | Selection | Operation]) -> str:
    def arg(a: object) -> str:
        return "(" + ",".join(map(arg, a)) + ")" if isinstance(a, tuple) else str(a)

    def one(t: Projection | Selection | Operation) -> str:
        if isinstance(t, Projection):
            return ",".join(t.ids)
        return f"{t.id}{t.op}{t.value}" if isinstance(t, Selection) else f"{t.name}({','.join(map(arg, t.args))})"

    return "&".join(map(one, terms))


def unquoted(text: str) -> str:
    """Without one leading and one trailing quote."""
    return text.removeprefix('"').removesuffix('"') if len(text) > 1 else text
