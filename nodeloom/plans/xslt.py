"""XSLT stylesheets as expressions: a sequence constructor becomes an expression for the text that it writes, evaluated by ``plans.xpath``.

The nodes of a level of the documents are transformed together, from the deepest level up, each by the best of the rules that match it. What they
write is a table, so ``apply-templates`` is a join with the results of the selected nodes: there is a job for each level and mode, and no recursion. It can thus
select only nodes deeper than its own, and passes no parameters. Named templates and functions are written out where they are called, so they can't call themselves.

There are: template rules with modes, priorities and precedence of imports, next-match, built-in rules; apply-templates, call-template, parameters, variables, for-each,
for-each-group (group-by), sort, perform-sort, if, choose, value-of, text, sequence, copy, element, attribute, comment, processing-instruction, literal elements with
value templates, number (value), message, assert, where-populated, document, functions, keys, current(), current-group(), current-grouping-key().
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as Tree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.templates import default_priority
from nodeloom.plans.parser import Parser
from nodeloom.plans.xpath import XPath
from nodeloom.sources import fixtures
from nodeloom.sources.xml import ATTR

XSL = "{http://www.w3.org/1999/XSL/Transform}"
_HERE = ("context",)
_NOTHING = ("string", "")


def _expr(text: str):
    return Parser(text).whole()


def _joined(parts: list):
    parts = [p for p in parts if p != _NOTHING]
    return _NOTHING if not parts else parts[0] if len(parts) == 1 else ("call", "concat", parts)


def _each(nodes, body):
    return "call", "string-join", [("map", nodes, body), _NOTHING]


def _walk(e, change):
    """The expression with ``change`` applied from the leaves on."""
    if isinstance(e, tuple):
        return change(tuple(_walk(x, change) for x in e))
    return [_walk(x, change) for x in e] if isinstance(e, list) else e


def _uses(e, name: str) -> bool:
    if isinstance(e, tuple) and e[:2] == ("call", name):
        return True
    return isinstance(e, tuple | list) and any(_uses(x, name) for x in e)


def _may_be_attributes(nodes) -> bool:
    """Of the expression of an apply-templates; only of paths and their unions it is known."""
    if nodes[0] == "path" and nodes[2]:
        return nodes[2][-1][0] in ("attribute", "self", "descendant-or-self", "ancestor-or-self") and nodes[2][-1][1][0] not in ("text", "comment", "processing-instruction", "element")
    return nodes[0] not in ("union", "root") or nodes[0] == "union" and any(map(_may_be_attributes, nodes[1:]))


class Stylesheet:
    """included: texts of imported and included stylesheets by href."""

    def __init__(self, text: str, included: dict[str, str] | None = None):
        self.rules, self.named, self.variables, self.functions, self.keys = [], {}, [], {}, {}
        self.method, self.included, self._precedence, self.on_no_match = "xml", included or {}, 0, {}
        self.namespaces: dict[str, str] = {}
        self.modes: set = set()
        #: Whether apply-templates may select attributes; else none is ever transformed.
        self.to_attributes = False
        self._read(text)

    def _read(self, text: str) -> None:
        self.namespaces |= dict(re.findall(r"""xmlns:([\w.-]+)\s*=\s*["']([^"']*)["']""", text))
        root = Tree.fromstring(text)
        top = list(root)
        for e in top:
            if e.tag == f"{XSL}import":
                self._read(self.included[e.get("href")])
        self._precedence += 1
        for e in top:
            self._declare(e)

    def _declare(self, e) -> None:
        kind = e.tag.removeprefix(XSL)
        if kind == "include":
            for x in Tree.fromstring(self.included[e.get("href")]):
                self._declare(x)
        elif kind == "template":
            if e.get("name"):
                self.named[e.get("name")] = e
            for pattern in (e.get("match") or "").split("|") if e.get("match") else ():
                pattern = pattern.strip()
                priority = float(e.get("priority")) if e.get("priority") else default_priority(pattern)
                for mode in (e.get("mode") or "").split() or [None]:
                    self.rules.append(((self._precedence, priority, len(self.rules)), pattern, mode, e))
        elif kind in ("variable", "param"):
            self.variables.append(e)
        elif kind == "function":
            self.functions[e.get("name")] = e
        elif kind == "key":
            self.keys[e.get("name")] = e
        elif kind == "output":
            self.method = e.get("method", "xml")
        elif kind == "mode":
            self.on_no_match[e.get("name")] = e.get("on-no-match", "text-only-copy")

    # -- expressions -----------------------------------------------------------------------------

    def expression(self, text: str):
        def change(e):
            if e[:1] == ("call",) and e[1] in self.functions:
                f = self.functions[e[1]]
                names = [p.get("name") for p in f if p.tag == f"{XSL}param"]
                return "apply", ("function", names, self._value_of_body(f)), e[2]
            if e[:2] == ("call", "key"):
                k = self.keys[e[2][0][1]]
                return "path", ("root",), [("descendant-or-self", ("node",), []), *self._last_steps(k.get("match"), ("general", "eq", _expr(k.get("use")), e[2][1]))]
            if e[:2] == ("call", "current"):
                return "variable", "__current"
            return e

        out = _walk(_expr(text), change)
        return ("for", "__current", _HERE, out) if _uses(_expr(text), "current") else out

    def _last_steps(self, pattern: str, condition):
        steps = list(_expr(pattern)[2])
        axis, test, predicates = steps[-1]
        return [*steps[:-1], (axis, test, [*predicates, condition])]

    def _value_of_body(self, e):
        parts = [x for x in e if x.tag != f"{XSL}param"]
        if len(parts) == 1 and parts[0].tag == f"{XSL}sequence":
            return self.expression(parts[0].get("select"))
        return self.body(e, 0, None)

    def template(self, text: str, name: str = "xml:attribute"):
        """An attribute value template."""
        parts = []
        for literal, e in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{([^{}]+)\}", text):
            parts.append(("string", literal.replace("{{", "{").replace("}}", "}")) if literal else ("call", name, [("call", "string-join", [self.expression(e), ("string", " ")])]))
        return _joined(parts)

    def text_of(self, e):
        made = ("call", "string-join", [e, ("string", " ")])
        return ("call", "xml:text", [made]) if self.method != "text" else made

    # -- rules -----------------------------------------------------------------------------------

    def pattern(self, pattern: str):
        """A test of the context node."""
        if pattern == "/":
            return "path", _HERE, [("self", ("document-node",), [])]
        e = _expr(pattern)
        steps = [s for s in e[2]]
        condition = None
        above = "parent"
        if e[1] == ("root",) and steps[0][0] != "descendant":
            condition = ("path", _HERE, [("parent", ("document-node",), [])])
        for axis, test, predicates in steps:
            if (axis, test) == ("descendant-or-self", ("node",)):
                above = "ancestor"
                continue
            test = ("attribute", *test[1:]) if axis == "attribute" else test
            here = ("path", _HERE, [("self", test, [*predicates, *([condition] if condition else [])])])
            step = here[2][0]
            if axis == "descendant" and condition:
                step = ("self", test, [*predicates, _walk(condition, lambda x: ("ancestor", *x[1:]) if x[:1] == ("parent",) else x)])
            last = step
            condition = ("path", _HERE, [(above, last[1], last[2])])
            above = "parent"
        return "path", _HERE, [last]

    def choice(self, mode, depth: int, below=None, given: dict | None = None):
        """What the best rule for the context node writes; below: only rules of a lower rank."""
        out = self.builtin(mode, depth, given)
        for rank, pattern, of, e in sorted((r for r in self.rules if r[2] in (mode, "#all")), key=lambda r: r[0]):
            if below is None or rank < below:
                out = ("if", self.pattern(pattern), self.body(e, depth, mode, rank, given), out)
        return out

    def ruled(self, mode) -> list:
        """What the built-in rule writes, then (pattern, what it writes) of each rule of the mode, the best last."""
        rules = sorted((r for r in self.rules if r[2] in (mode, "#all")), key=lambda r: r[0])
        return [self.builtin(mode, 0, None), *[(pattern, self.body(e, 0, mode, rank)) for rank, pattern, _, e in rules]]

    def builtin(self, mode, depth: int, given):
        how = self.on_no_match.get(mode, "text-only-copy")
        if how in ("deep-skip", "fail"):
            return _NOTHING if how == "deep-skip" else ("call", "error", [("string", "XTDE0555: no rule matches")])
        text = self.text_of(("call", "string", [_HERE])) if how != "shallow-skip" else _NOTHING
        inner = self.applied(("path", _HERE, [("child", ("node",), [])]), mode, depth, given)
        here = lambda kind: ("path", _HERE, [("self", (kind,), [])])
        copied = inner
        if how == "shallow-copy":
            copied = _joined([("string", "<"), ("call", "name", []), self.attributes(), ("string", ">"), inner, ("string", "</"), ("call", "name", []), ("string", ">")])
        return "if", ("or", here("text"), here("attribute")), text, ("if", here("element"), copied, ("if", here("document-node"), inner, _NOTHING))

    def attributes(self):
        return _each(("path", _HERE, [("attribute", ("name", "*"), [])]), _joined([("string", " "), ("call", "name", []), ("string", '="'), ("call", "xml:attribute", [("call", "string", [_HERE])]), ("string", '"')]))

    def applied(self, nodes, mode, depth: int, given=None, keys=()):
        if given:
            raise SyntaxError("apply-templates with parameters is not built")
        self.modes.add(mode)
        self.to_attributes |= _may_be_attributes(nodes)
        return self.ordered(nodes, keys, ("result", mode))

    def ordered(self, nodes, keys, body):
        if not keys:
            return _each(nodes, body)
        return "call", "string-join", [("sorted", nodes, [(self.expression(k.get("select", ".")), k.get("data-type") == "number", k.get("order") == "descending") for k in keys], body), _NOTHING]

    # -- sequence constructors -------------------------------------------------------------------

    def body(self, e, depth: int, mode, rank=None, given: dict | None = None):
        if depth > 40:
            raise RecursionError("a template or function calls itself")
        given = dict(given or {})
        return self.rest([("text", e.text), *[y for x in e for y in (x, ("text", x.tail))]], depth, mode, rank, given)

    def rest(self, items, depth, mode, rank, given):
        parts = []
        for i, x in enumerate(items):
            if isinstance(x, tuple):
                if x[1] and x[1].strip():
                    parts.append(("string", x[1] if self.method == "text" else x[1].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")))
                continue
            if x.tag in (f"{XSL}variable", f"{XSL}param"):
                name = x.get("name")
                value = given.pop(name) if x.tag.endswith("param") and name in given else self.expression(x.get("select")) if x.get("select") else self.body(x, depth, mode)
                return _joined([*parts, ("let", name, value, self.rest(items[i + 1 :], depth, mode, rank, given))])
            parts.append(self.instruction(x, depth, mode, rank))
        return _joined(parts)

    def instruction(self, e, depth: int, mode, rank):
        kind = e.tag.removeprefix(XSL)
        select = lambda: self.expression(e.get("select"))
        inner = lambda: self.body(e, depth, mode, rank)
        if not e.tag.startswith(XSL):
            return self.element(("string", e.tag.rpartition("}")[2]), e, depth, mode, rank, [_joined([("string", f' {n.rpartition("}")[2]}="'), self.template(v), ("string", '"')]) for n, v in e.attrib.items()])
        if kind == "text":
            return "string", (e.text or "") if self.method == "text" else (e.text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        if kind in ("value-of", "sequence"):
            if e.get("separator") is not None:
                made = ("call", "string-join", [select(), ("string", e.get("separator"))])
                return ("call", "xml:text", [made]) if self.method != "text" else made
            return self.text_of(select()) if e.get("select") else inner()
        if kind == "if":
            return "if", self.expression(e.get("test")), inner(), _NOTHING
        if kind == "choose":
            out = _NOTHING
            for x in reversed(list(e)):
                made = self.body(x, depth, mode, rank)
                out = made if x.tag == f"{XSL}otherwise" else ("if", self.expression(x.get("test")), made, out)
            return out
        keys = [x for x in e if x.tag == f"{XSL}sort"]
        plain = [y for x in e if x.tag not in (f"{XSL}sort", f"{XSL}with-param") for y in (x, ("text", x.tail))]
        if kind == "for-each":
            return self.ordered(select(), keys, self.rest([("text", e.text), *plain], depth, mode, rank, {}))
        if kind == "perform-sort":
            return "call", "string-join", [("sorted", select(), [(self.expression(k.get("select", ".")), k.get("data-type") == "number", k.get("order") == "descending") for k in keys], ("call", "string", [_HERE])), ("string", " ")]
        if kind == "for-each-group":
            return self.groups(e, self.rest([("text", e.text), *plain], depth, mode, rank, {}))
        given = {x.get("name"): self.expression(x.get("select")) if x.get("select") else self.body(x, depth, mode) for x in e if x.tag == f"{XSL}with-param"}
        if kind == "apply-templates":
            nodes = select() if e.get("select") else ("path", _HERE, [("child", ("node",), [])])
            return self.applied(nodes, e.get("mode") if e.get("mode") != "#current" else mode, depth, given, keys)
        if kind == "call-template":
            return self.body(self.named[e.get("name")], depth + 1, mode, rank, given)
        if kind in ("next-match", "apply-imports"):
            below = rank if kind == "next-match" else (rank[0], float("-inf"), -1)
            return self.choice(mode, depth, below, given)
        if kind == "copy":
            made = _joined([("string", "<"), ("call", "name", []), self.own_attributes(e, depth, mode, rank), ("string", ">"), self.without_attributes(e, depth, mode, rank), ("string", "</"), ("call", "name", []), ("string", ">")])
            return "if", ("path", _HERE, [("self", ("element",), [])]), made, ("if", ("path", _HERE, [("self", ("text",), [])]), self.text_of(("call", "string", [_HERE])), self.without_attributes(e, depth, mode, rank))
        if kind == "element":
            return self.element(self.template(e.get("name"), "string"), e, depth, mode, rank, [])
        if kind == "comment":
            return _joined([("string", "<!--"), select() if e.get("select") else inner(), ("string", "-->")])
        if kind == "processing-instruction":
            return _joined([("string", "<?"), self.template(e.get("name"), "string"), ("string", " "), select() if e.get("select") else inner(), ("string", "?>")])
        if kind == "number" and e.get("value"):
            return "call", "format-integer", [self.expression(e.get("value")), ("string", e.get("format", "1"))]
        if kind == "where-populated":
            return "let", "__made", inner(), ("if", ("call", "matches", [("variable", "__made"), ("string", ">[^<]|[^>]$")]), ("variable", "__made"), _NOTHING)
        if kind == "message":
            return ("call", "error", [("string", "XTMM9000"), inner()]) if e.get("terminate") == "yes" else _NOTHING
        if kind == "assert":
            return "if", self.expression(e.get("test")), _NOTHING, ("call", "error", [("string", "XTMM9001"), _joined([inner()])])
        if kind in ("document", "fallback"):
            return inner() if kind == "document" else _NOTHING
        raise SyntaxError(f"this instruction is not known: {kind}")

    def own_attributes(self, e, depth, mode, rank):
        out = []
        for x in e:
            if x.tag == f"{XSL}attribute":
                value = self.expression(x.get("select")) if x.get("select") else None
                made = ("call", "string-join", [value, ("string", " ")]) if value is not None else self.body(x, depth, mode, rank)
                out.append(_joined([("string", " "), self.template(x.get("name"), "string"), ("string", '="'), ("call", "xml:attribute", [made]) if value is not None else made, ("string", '"')]))
        return _joined(out)

    def without_attributes(self, e, depth, mode, rank):
        return self.rest([("text", e.text), *[y for x in e for y in (*([x] if x.tag != f"{XSL}attribute" else []), ("text", x.tail))]], depth, mode, rank, {})

    def element(self, name, e, depth, mode, rank, attributes):
        inner = self.without_attributes(e, depth, mode, rank)
        head = [("string", "<"), name, *attributes, self.own_attributes(e, depth, mode, rank)]
        if inner == _NOTHING:
            return _joined([*head, ("string", "/>")])
        return _joined([*head, ("string", ">"), inner, ("string", "</"), name, ("string", ">")])

    def groups(self, e, body):
        nodes, by = self.expression(e.get("select")), self.expression(e.get("group-by"))
        mine = ("filter", nodes, ("general", "eq", by, ("variable", "__key")))

        def change(x):
            if x[:2] == ("call", "current-grouping-key"):
                return "variable", "__key"
            return mine if x[:2] == ("call", "current-group") else x

        # a group's content is evaluated at its first item; so far that can only be its key and current-group()
        keys = ("call", "distinct-values", [("map", nodes, by)])
        if any(x.tag == f"{XSL}sort" for x in e):
            keys = ("call", "sort", [keys])
        return "call", "string-join", [("for", "__key", keys, _walk(body, change)), _NOTHING]

    # -- what users call -------------------------------------------------------------------------

    def transform(self, nodes: DataFrame, parameters: dict[str, object] | None = None, mode: str | None = None) -> DataFrame:
        """(doc_id, text) of each document."""
        spark = nodes.sparkSession
        bodies, waiting = {}, {mode}
        while waiting - bodies.keys():
            for m in waiting - bodies.keys():
                bodies[m] = self.ruled(m)
            waiting |= self.modes

        def bound(made, m):
            for v in reversed(self.variables):
                if v.get("name") not in (parameters or {}):
                    made = ("let", v.get("name"), self.expression(v.get("select")) if v.get("select") else self.body(v, 0, m), made)
            return made

        x = XPath(nodes, self.namespaces)
        results = fixtures.Results(spark, getattr(nodes, "buckets", None))
        x.results = spark.createDataFrame([], "doc_id long, pre long, mode string, text string")
        below = nodes if self.to_attributes else nodes.where(F.col("kind") != ATTR)
        # which rule each node takes, so that a body is evaluated for its own nodes only
        taken = fixtures.Results(spark, getattr(nodes, "buckets", None))
        for m, made in bodies.items():
            which = ("number", "integer", -1)
            for i, (pattern, _) in enumerate(made[1:]):
                which = ("if", self.pattern(pattern), ("number", "integer", i), which)
            rows = x.evaluate({"rule": bound(which, m)}, below, parameters, distinct=True)
            taken.add(rows.select("doc_id", "pre", F.lit(m or "").alias("mode"), "rule"))
        rules = taken.table()
        found = rules.join(below.select("doc_id", "pre", "level"), ["doc_id", "pre"]).select("level", "mode", "rule").distinct().collect()
        for level in range(max((r["level"] for r in found), default=-1), -1, -1):
            for m, made in bodies.items():
                for rule in sorted(r["rule"] for r in found if (r["level"], r["mode"]) == (level, m or "")):
                    mine = rules.where((F.col("mode") == (m or "")) & (F.col("rule") == rule)).select("doc_id", "pre")
                    here = below.where(F.col("level") == level).join(mine, ["doc_id", "pre"], "left_semi")
                    out = x.evaluate({"text": bound(made[0] if rule < 0 else made[rule + 1][1], m)}, here, parameters, distinct=True)
                    results.add(out.select("doc_id", "pre", F.lit(m or "").alias("mode"), F.coalesce("text", F.lit("")).alias("text")).where("text <> '' or pre = 0"))
            x.results = results.table()
        return x.results.where((F.col("pre") == 0) & (F.col("mode") == (mode or ""))).select("doc_id", "text")
