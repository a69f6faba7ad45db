"""Reading semi-structured documents: parsing with unwrapping, name folding, and the walk that shreds them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any


def fold(name: str) -> str:
    """Field names are compared ignoring case and underscores."""
    return name.replace("_", "").lower()


def unwrap(value: Any) -> Any:
    """A string that holds a JSON object, list or string stands for that value, at any number of wrappings."""
    while isinstance(value, str):
        text = value.strip()
        if text[:1] not in ("{", "[", '"'):
            return value
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return value
    return value


def parse(text: str | None) -> Any:
    """The document's value, or None if it can't be parsed (null, empty, broken or nested beyond the parser's limit)."""
    if text is None:
        return None
    try:
        return unwrap(json.loads(text.lstrip("﻿")))
    except (ValueError, RecursionError):
        return None


def scalar(value: Any) -> str | None:
    """Text of a leaf: strings as they are, other values as JSON."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def graph_edges(text: str | None) -> Iterator[tuple[str, str, bool, bool, int]]:
    """(parent type, child type, is object, is list, most in one parent) of one document; types are folded names."""
    root = parse(text)
    stack: list[tuple[str, Any]] = [("", root)]
    while stack:
        kind, value = stack.pop()
        if isinstance(value, list):
            for item in value:
                item = unwrap(item)
                if isinstance(item, (dict, list)):
                    stack.append((kind, item))
        elif isinstance(value, dict):
            for name, child in value.items():
                child, key = unwrap(child), fold(name)
                holds = isinstance(child, dict) or (isinstance(child, list) and any(isinstance(unwrap(x), dict) for x in child))
                yield kind, key, holds, isinstance(child, list), len(child) if isinstance(child, list) else 1
                if isinstance(child, (dict, list)):
                    stack.append((key, child))


Row = tuple[str, str, str | None, str | None, int, int, str, dict[str, str | None]]


def kind_of(value: Any) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "list"
    if isinstance(value, str):
        return "string"
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number"


def shred(text: str | None, tables: frozenset[str], entries: frozenset[str], guarded: frozenset[str]) -> list[Row]:
    """Rows (table, row id, parent table, parent row, position, guards, via, columns) of one document.

    A child whose type is in ``tables`` becomes rows of its own, one per element (a lone object is a list of one, a
    null element gives no row but keeps its position); other objects are inlined, their leaves named by their path.
    A child in ``entries`` is a free-form object: one row per key. ``guards`` counts the elements of ``guarded`` types
    above the row, ``via`` is the path of inlined names between it and its parent row. The root's table is ''.
    """
    root = parse(text)
    if not isinstance(root, (dict, list)):
        return []
    first: dict[str, str | None] = {}
    out: list[Row] = [("", "", None, None, 0, 0, "", first)]
    # value, inlined path folded and as spelt, row id, table, guards, columns of the row
    stack: list[tuple[Any, str, str, str, str, int, dict[str, str | None]]] = [(root, "", "", "", "", 0, first)]
    while stack:
        value, path, spelt, row, table, guards, columns = stack.pop()
        if isinstance(value, list):
            for i, item in enumerate(value):
                item = unwrap(item)
                if isinstance(item, (dict, list)):
                    stack.append((item, f"{path}{i}.", f"{spelt}{i}.", row, table, guards, columns))
                elif item is not None:
                    columns[f"{path}{i}"] = scalar(item)
            continue
        for name, child in value.items():
            child, key = unwrap(child), fold(name)
            here = f"{row}/{spelt}{name}"
            if key in entries and isinstance(child, dict):
                for i, (k, v) in enumerate(child.items()):
                    inner = unwrap(v)
                    nested = isinstance(inner, (dict, list))
                    rid, cols = f"{here}[{i}]", {"key": k, "kind": kind_of(inner), "value": None if nested else scalar(inner)}
                    out.append((key, rid, table, row, i, guards, path, cols))
                    if nested:
                        stack.append(({k: inner}, "", "", rid, key, guards, cols))
            elif key in tables and isinstance(child, (dict, list)):
                below = guards + (key in guarded)
                for i, item in enumerate(child if isinstance(child, list) else [child]):
                    item = unwrap(item)
                    if item is None:
                        continue
                    rid, cols = f"{here}[{i}]", {}
                    out.append((key, rid, table, row, i, guards, path, cols))
                    if isinstance(item, (dict, list)):
                        stack.append((item, "", "", rid, key, below, cols))
                    else:
                        cols["value"] = scalar(item)
            elif isinstance(child, (dict, list)):
                stack.append((child, f"{path}{key}.", f"{spelt}{name}.", row, table, guards, columns))
            else:
                columns[path + key] = scalar(child)
    return out
