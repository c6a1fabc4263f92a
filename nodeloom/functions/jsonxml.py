"""JSON text to its XML vocabulary and back, and keys at any depth. Spark has no such expressions, hence Arrow batches, a text at a time."""

from __future__ import annotations

import json
from xml.etree import ElementTree as Tree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NS = "http://www.w3.org/2005/xpath-functions"


class _Number(str):
    """A number as it was written."""


class _Pairs(list):
    """An object's members in their order, repeats included."""


def _load(text: str):
    return json.loads(text, parse_int=_Number, parse_float=_Number, object_pairs_hook=_Pairs)


def _element(value, key: str | None) -> Tree.Element:
    if isinstance(value, _Pairs):
        e = Tree.Element("map")
        seen: set[str] = set()
        for k, v in value:
            if k not in seen:
                seen.add(k)
                e.append(_element(v, k))
    elif isinstance(value, list):
        e = Tree.Element("array")
        e.extend(_element(v, None) for v in value)
    else:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, _Number) else "string"
        e = Tree.Element(kind)
        if kind != "null":
            e.text = ("true" if value else "false") if kind == "boolean" else str(value)
    if key is not None:
        e.set("key", key)
    return e


def _to_xml(text: str | None) -> str | None:
    try:
        root = _element(_load(text), None) if text is not None else None
    except ValueError:
        return None
    if root is None:
        return None
    root.attrib = {"xmlns": NS, **root.attrib}
    return Tree.tostring(root, encoding="unicode", short_empty_elements=True).replace(" />", "/>")


def _to_json(e: Tree.Element) -> str:
    kind = e.tag.rpartition("}")[2]
    quoted = lambda s: json.dumps(s, ensure_ascii=False).replace("/", "\\/")
    if kind == "map":
        return "{" + ",".join(f"{quoted(c.get('key', ''))}:{_to_json(c)}" for c in e) + "}"
    if kind == "array":
        return "[" + ",".join(map(_to_json, e)) + "]"
    if kind == "string":
        return quoted(e.text or "")
    if kind == "boolean":
        return "true" if (e.text or "").strip() in ("true", "1") else "false"
    if kind == "null":
        return "null"
    if kind == "number":
        return (e.text or "").strip()
    raise ValueError(f"FOJS0006: {kind}")


def _from_xml(text: str | None) -> str | None:
    try:
        return None if text is None else _to_json(Tree.fromstring(text))
    except (Tree.ParseError, ValueError):
        return None


def _found(value, key: str, out: list[str]) -> list[str]:
    """Members called ``key``, outer ones first."""
    if isinstance(value, _Pairs):
        for k, v in value:
            if k == key:
                out.append(_plain(v))
            _found(v, key, out)
    elif isinstance(value, list):
        for v in value:
            _found(v, key, out)
    return out


def _plain(v) -> str:
    if isinstance(v, _Number):
        return str(v)
    if isinstance(v, _Pairs):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_plain(x)}" for k, x in v) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_plain, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def _each(f, result: str):
    @F.pandas_udf(result)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in s], dtype=object)

    return run


def json_to_xml(text: Column) -> Column:
    """fn:json-to-xml as text; of repeated keys the first counts; null for what is no JSON."""
    return _each(_to_xml, "string")(text)


def xml_to_json(text: Column) -> Column:
    """fn:xml-to-json; null for what is not the vocabulary."""
    return _each(_from_xml, "string")(text)


def map_find(text: Column, key: str) -> Column:
    """map:find over JSON: the values (as JSON) of every member called ``key`` at any depth."""

    def find(x):
        try:
            return None if x is None else _found(_load(x), key, [])
        except ValueError:
            return None

    return _each(find, "array<string>")(text)
