"""Schematron schemas from their own documents: violations by compiled expressions."""

from __future__ import annotations

import re
import xml.etree.ElementTree as Tree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.plans.parser import Parser
from nodeloom.plans.xpath import XPath

SCH = "{http://purl.oclc.org/dsdl/schematron}"


def _message(e, lets) -> tuple:
    """The text of an assertion with value-of and name evaluated."""
    parts = [("string", e.text or "")]
    for x in e:
        kind = x.tag.removeprefix(SCH)
        if kind == "value-of":
            parts.append(("call", "string-join", [Parser(x.get("select")).whole(), ("string", " ")]))
        elif kind == "name":
            parts.append(("call", "name", [Parser(x.get("path")).whole()] if x.get("path") else []))
        else:
            parts.append(("string", "".join(x.itertext())))
        parts.append(("string", x.tail or ""))
    return _bound(lets, ("call", "normalize-space", [("call", "concat", parts)]))


def _bound(lets, e):
    for name, value in reversed(lets):
        e = ("let", name, Parser(value).whole(), e)
    return e


def _lets(e) -> list[tuple[str, str]]:
    return [(x.get("name"), x.get("value")) for x in e if x.tag == f"{SCH}let"]


def validate(nodes: DataFrame, schema: str, phase: str | None = None) -> DataFrame:
    """(doc_id, pre, pattern, kind, rule, message): a row for each failed ``assert`` and each ``report`` that holds.

    In a pattern each node is tested by the first rule whose context it matches. ``let`` of schema, pattern and rule are bound in order,
    ``extends`` takes over the tests of an abstract rule, ``phase`` picks its active patterns. rule: the id of the test, or its expression.
    """
    root = Tree.fromstring(schema)
    spaces = {x.get("prefix"): x.get("uri") for x in root.iter(f"{SCH}ns")}
    abstract = {r.get("id"): r for r in root.iter(f"{SCH}rule") if r.get("abstract") == "true"}
    active = None if phase is None else {a.get("pattern") for p in root.iter(f"{SCH}phase") if p.get("id") == phase for a in p.iter(f"{SCH}active")}
    found = None
    for number, pattern in enumerate(root.iter(f"{SCH}pattern")):
        if active is not None and pattern.get("id") not in active:
            continue
        earlier = None
        for rule in pattern.iter(f"{SCH}rule"):
            if rule.get("abstract") == "true":
                continue
            x = XPath(nodes, spaces)
            paths = [p.strip() for p in re.split(r"\|(?![^\[]*\])", rule.get("context"))]
            context = x.select(" | ".join(p if p.startswith("/") else f"//{p}" for p in paths))
            if earlier is not None:
                context = context.join(earlier, ["doc_id", "pre"], "left_anti")
            lets = [*_lets(root), *_lets(pattern), *_lets(rule)]
            tests = [t for e in rule for t in ([e] if e.tag != f"{SCH}extends" else list(abstract[e.get("rule")])) if t.tag in (f"{SCH}assert", f"{SCH}report")]
            asked = {}
            for i, t in enumerate(tests):
                held = ("call", "boolean", [Parser(t.get("test")).whole()])
                asked[f"t{i}"], asked[f"m{i}"] = _bound(lets, held), _message(t, lets)
            rows = x.evaluate(asked, context)
            fired = [
                F.when(F.col(f"t{i}") if t.tag == f"{SCH}report" else ~F.col(f"t{i}"), F.struct(F.lit(t.tag.removeprefix(SCH)).alias("kind"), F.lit(t.get("id") or t.get("test")).alias("rule"), F.col(f"m{i}").alias("message")))
                for i, t in enumerate(tests)
            ]
            rows = rows.select("doc_id", "pre", F.lit(pattern.get("id") or str(number)).alias("pattern"), F.explode(F.filter(F.array(*fired), lambda v: v.isNotNull())).alias("v")).select("doc_id", "pre", "pattern", "v.*")
            found = rows if found is None else found.unionByName(rows)
            mine = context.select("doc_id", "pre")
            earlier = mine if earlier is None else earlier.unionByName(mine)
    return found
