"""XML Schema documents compiled to queries for violations: content models, attributes, simple types, identity constraints.

Covered: global and local elements, named and anonymous types, sequence, choice, all, groups, occurrence, any, mixed and simple content, extension of types, attributes with
use, fixed and type, attribute groups, restriction, list and union of simple types with facets, unique, key, keyref with selector and field paths. Elements are known by name and type of the
element above; one name has one type within a parent type.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as Tree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions import values
from nodeloom.operators import constraints
from nodeloom.plans import axes
from nodeloom.plans.xpath import XPath
from nodeloom.sources.xml import ELEM

XS = "{http://www.w3.org/2001/XMLSchema}"


def _local(name: str | None) -> str | None:
    return name.rpartition(":")[2] if name else name


class Schema:
    def __init__(self, text: str):
        self.root = Tree.fromstring(text)
        top = lambda kind: {e.get("name"): e for e in self.root if e.tag == f"{XS}{kind}"}
        self.elements, self.types, self.simple = top("element"), top("complexType"), top("simpleType")
        self.groups, self.attribute_groups, self.attributes = top("group"), top("attributeGroup"), top("attribute")

    # -- simple types ----------------------------------------------------------------------------

    def holds(self, value: Column, kind: str | None, inline=None) -> Column:
        """Whether the text is a value of the simple type, by name or declared within an element."""
        e = inline if inline is not None else self.simple.get(_local(kind))
        if e is None:
            local = _local(kind)
            if local in (None, "anySimpleType", "anyType", "string", "untypedAtomic"):
                return F.lit(True)
            if local in ("NMTOKENS", "IDREFS", "ENTITIES"):
                words = F.split(F.trim(F.regexp_replace(value, "[ \t\r\n]+", " ")), " ")
                return F.forall(words, lambda w: F.coalesce(values.castable_as(w, local[:-1]), F.lit(False)))
            return F.coalesce(values.castable_as(value, local), F.lit(False))
        for x in e:
            if x.tag == f"{XS}restriction":
                base, nested = x.get("base"), x.find(f"{XS}simpleType")
                return self.holds(value, base, nested) & self.facets(value, self.primitive(base, nested), x)
            if x.tag == f"{XS}list":
                words = F.filter(F.split(F.trim(F.regexp_replace(value, "[ \t\r\n]+", " ")), " "), lambda w: w != "")
                return F.forall(words, lambda w: self.holds(w, x.get("itemType"), x.find(f"{XS}simpleType")))
            if x.tag == f"{XS}union":
                out = F.lit(False)
                for member in (x.get("memberTypes") or "").split():
                    out = out | self.holds(value, member)
                for nested in x.findall(f"{XS}simpleType"):
                    out = out | self.holds(value, None, nested)
                return out
        return F.lit(True)

    def primitive(self, kind: str | None, inline=None) -> str:
        e = inline if inline is not None else self.simple.get(_local(kind))
        if e is None:
            return _local(kind) or "string"
        r = e.find(f"{XS}restriction")
        return self.primitive(r.get("base"), r.find(f"{XS}simpleType")) if r is not None else "list" if e.find(f"{XS}list") is not None else "string"

    def facets(self, value: Column, kind: str, e) -> Column:
        collapsed = value if kind in ("string", "normalizedString") else F.trim(F.regexp_replace(value, "[ \t\r\n]+", " "))
        space = next((x.get("value") for x in e if x.tag == f"{XS}whiteSpace"), None)
        v = F.trim(F.regexp_replace(value, "[ \t\r\n]+", " ")) if space == "collapse" else F.translate(value, "\t\n\r", "   ") if space == "replace" else collapsed
        ordered = (lambda t: values.cast_as(t, kind)) if kind in ("date", "dateTime", "time", "gYear") else (lambda t: t.try_cast("decimal(38,12)")) if kind not in ("double", "float") else (lambda t: values.cast_as(t, "double"))
        length = F.size(F.filter(F.split(v, " "), lambda w: w != "")) if kind == "list" else F.length(v) / 2 if kind == "hexBinary" else F.length(v)
        digits = F.regexp_replace(F.regexp_replace(v, "^[+-]?0*|[.]0*$", ""), "[.]([0-9]*?)0*$", ".$1")
        out, choices, patterns = F.lit(True), [], []
        for x in e:
            name, want = x.tag.removeprefix(XS), x.get("value")
            if name == "enumeration":
                choices.append(want)
            elif name == "pattern":
                patterns.append(want)
            elif name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
                a, b = ordered(v), ordered(F.lit(want))
                out = out & {"minInclusive": a >= b, "maxInclusive": a <= b, "minExclusive": a > b, "maxExclusive": a < b}[name]
            elif name in ("length", "minLength", "maxLength"):
                out = out & {"length": length == int(want), "minLength": length >= int(want), "maxLength": length <= int(want)}[name]
            elif name == "totalDigits":
                out = out & (F.length(F.regexp_replace(digits, "[^0-9]", "")) <= int(want))
            elif name == "fractionDigits":
                out = out & (F.length(F.regexp_extract(digits, "[.]([0-9]*)$", 1)) <= int(want))
            elif name == "explicitTimezone" and want != "optional":
                zoned = v.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$")
                out = out & (zoned if want == "required" else ~zoned)
        if choices:
            out = out & v.isin(*choices)
        if patterns:
            from nodeloom.functions import fn

            out = out & v.rlike("^(?:" + "|".join(f"(?:{fn.flags(p)})" for p in patterns) + ")$")
        return F.coalesce(out, F.lit(False))

    # -- complex types ---------------------------------------------------------------------------

    def type_of(self, element):
        """(simple type name, simple type declared within, complex type) of an element declaration."""
        if element.get("ref"):
            return self.type_of(self.elements[_local(element.get("ref"))])
        inner = element.find(f"{XS}complexType")
        if inner is not None:
            return None, None, inner
        if element.find(f"{XS}simpleType") is not None:
            return None, element.find(f"{XS}simpleType"), None
        kind = _local(element.get("type"))
        return (None, None, self.types[kind]) if kind in self.types else (element.get("type"), None, None)

    def parts(self, complex_):
        """(model group, attribute declarations, simple base or None, mixed) with what an extension adds to."""
        mixed = complex_.get("mixed") == "true"
        for content in ("complexContent", "simpleContent"):
            c = complex_.find(f"{XS}{content}")
            if c is None:
                continue
            x = c.find(f"{XS}extension") if c.find(f"{XS}extension") is not None else c.find(f"{XS}restriction")
            base = _local(x.get("base"))
            model, attributes, simple = self._own(x)
            if base in self.types:
                above, more, simple, m = self.parts(self.types[base])
                if x.tag == f"{XS}extension":
                    model = [*above, *model]
                attributes, mixed = {**more, **attributes}, mixed or m
            elif content == "simpleContent":
                simple = x
            return model, attributes, simple, mixed
        model, attributes, _ = self._own(complex_)
        return model, attributes, None, mixed

    def _own(self, e):
        model, attributes = [], {}
        for x in e:
            kind = x.tag.removeprefix(XS)
            if kind in ("sequence", "choice", "all", "group"):
                model.append(x)
            elif kind == "attribute":
                d = self.attributes.get(_local(x.get("ref")), x)
                attributes[_local(x.get("name") or x.get("ref"))] = (x, d)
            elif kind == "attributeGroup":
                attributes |= self._own(self.attribute_groups[_local(x.get("ref"))])[1]
            elif kind == "anyAttribute":
                attributes["*"] = (x, x)
        return model, attributes, None

    def regex(self, particle) -> str:
        """The particle as a regular expression over child names, each followed by a blank."""
        kind = particle.tag.removeprefix(XS)
        if kind == "element":
            one = re.escape(_local(particle.get("name") or particle.get("ref"))) + " "
        elif kind == "any":
            one = "[^ ]+ "
        elif kind == "group":
            one = "".join(self.regex(x) for x in self.groups[_local(particle.get("ref"))])
        elif kind == "sequence":
            one = "".join(self.regex(x) for x in particle if x.tag != f"{XS}annotation")
        elif kind == "choice":
            one = "|".join(self.regex(x) for x in particle if x.tag != f"{XS}annotation")
        elif kind == "all":
            # any order: each name as often as it may be, which the look-aheads count
            names = [(re.escape(_local(x.get("name") or x.get("ref"))), int(x.get("minOccurs", 1)), x.get("maxOccurs", "1")) for x in particle if x.tag == f"{XS}element"]
            counts = "".join(f"(?=(?:(?!{n} )[^ ]+ )*(?:{n} (?:(?!{n} )[^ ]+ )*){{{low},{'' if high == 'unbounded' else high}}}$)" for n, low, high in names)
            one = f"{counts}(?:{'|'.join(f'{n} ' for n, _, _ in names)})*"
        else:
            one = ""
        low, high = particle.get("minOccurs", "1"), particle.get("maxOccurs", "1")
        return f"(?:{one})" if (low, high) == ("1", "1") or kind == "all" else f"(?:{one}){{{low},{'' if high == 'unbounded' else high}}}"

    def children(self, particles):
        for p in particles:
            kind = p.tag.removeprefix(XS)
            if kind == "element":
                yield p
            elif kind == "group":
                yield from self.children(self.groups[_local(p.get("ref"))])
            elif kind in ("sequence", "choice", "all"):
                yield from self.children(p)

    # -- validation ------------------------------------------------------------------------------

    def validate(self, nodes: DataFrame, root: str | None = None) -> DataFrame:
        """(doc_id, pre, rule, message) of what breaks the schema. root: name of the root element, any global one else."""
        tops = [self.elements[root]] if root else list(self.elements.values())
        found = [self._found(nodes.where((F.col("kind") == ELEM) & (F.col("level") == 1) & ~F.col("local").isin(*[e.get("name") for e in tops])), "root", F.col("local"))]
        seen: list[str] = []
        for e in tops:
            self._element(e, f"/{e.get('name')}", nodes, found, seen)
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    @staticmethod
    def _found(rows: DataFrame, rule: str, message: Column) -> DataFrame:
        return rows.select("doc_id", "pre", F.lit(rule).alias("rule"), message.alias("message"))

    def _element(self, e, path: str, nodes: DataFrame, found: list, seen: list) -> None:
        if path in seen or path.count("/") > 40:
            return
        seen.append(path)
        declared = self.elements.get(_local(e.get("ref")), e)
        x = XPath(nodes)
        here = x.select(path)
        kind, inline, complex_ = self.type_of(e)
        name = path.rpartition("/")[2]
        if complex_ is None:
            text = axes.string_value(here, nodes)
            found.append(self._found(text.where(~self.holds(F.col("text"), kind, inline)), f"type {name}", F.col("text")))
            if kind is not None or inline is not None:
                children = nodes.where(F.col("kind") == ELEM).select("doc_id", F.col("parent").alias("pre"))
                found.append(self._found(here.join(children.distinct(), ["doc_id", "pre"], "left_semi"), f"content {name}", F.lit("children in simple content")))
            if declared.get("fixed") is not None:
                found.append(self._found(text.where(F.col("text") != declared.get("fixed")), f"fixed {name}", F.col("text")))
        else:
            model, attributes, simple, mixed = self.parts(complex_)
            pattern = "".join(self.regex(p) for p in model)
            scope = nodes.join(here.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"], "left_semi").unionByName(nodes.join(here.select("doc_id", "pre"), ["doc_id", "pre"], "left_semi").withColumn("parent", F.lit(None).cast("long")), allowMissingColumns=True)
            broken = constraints.content_model(scope, {name: pattern}, f"content {name}").join(here.select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")
            found.append(broken)
            if not mixed and simple is None:
                loose = x.select("text()", here).where(~F.col("value").rlike("^[ \t\r\n]*$"))
                found.append(self._found(loose, f"text {name}", F.col("value")))
            if simple is not None:
                text = axes.string_value(here, nodes)
                ok = self.holds(F.col("text"), simple.get("base")) & self.facets(F.col("text"), self.primitive(simple.get("base")), simple)
                found.append(self._found(text.where(~ok), f"type {name}", F.col("text")))
            self._attributes(here, name, attributes, found)
            for child in self.children(model):
                self._element(child, f"{path}/{_local(child.get('name') or child.get('ref'))}", nodes, found, seen)
        self._identities(declared, path, nodes, found)

    def _attributes(self, here: DataFrame, name: str, attributes: dict, found: list) -> None:
        held = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
        tests = []
        for n, (use, d) in attributes.items():
            if n == "*":
                continue
            value = held[n]
            if use.get("use") == "required":
                tests.append((f"required {name}/@{n}", value.isNull(), F.lit(n)))
            if use.get("use") == "prohibited":
                tests.append((f"prohibited {name}/@{n}", value.isNotNull(), F.lit(n)))
            fixed = use.get("fixed") or d.get("fixed")
            if fixed is not None:
                tests.append((f"fixed {name}/@{n}", value != fixed, value))
            tests.append((f"type {name}/@{n}", ~self.holds(value, d.get("type"), d.find(f"{XS}simpleType")), value))
        if "*" not in attributes:
            other = F.filter(F.map_keys(held), lambda k: ~k.isin(*[n for n, (u, _) in attributes.items()], "") & ~k.startswith("{http://www.w3.org/"))
            tests.append((f"undeclared {name}", F.size(other) > 0, F.array_join(other, " ")))
        if tests:
            fired = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.coalesce(m, F.lit("")).alias("message"))) for rule, bad, m in tests]), lambda v: v.isNotNull())
            found.append(here.select("doc_id", "pre", F.explode(fired).alias("v")).select("doc_id", "pre", "v.rule", "v.message"))

    def _identities(self, e, path: str, nodes: DataFrame, found: list) -> None:
        keys = {}
        for kind in ("unique", "key", "keyref"):
            for c in e.findall(f"{XS}{kind}"):
                x = XPath(nodes)
                selector, fields = c.find(f"{XS}selector").get("xpath"), [f.get("xpath") for f in c.findall(f"{XS}field")]
                hosts = x.select(path)
                names = [f"f{i}" for i in range(len(fields))]
                # each selected node with its fields and its host
                asked = {n: ("call", "head", [("call", "data", [x_])]) for n, x_ in zip(names, map(_parsed, fields), strict=True)}
                rows = x.evaluate(asked, x.select(f"{path}/{selector}"))
                within = rows.alias("r").join(hosts.select("doc_id", F.col("pre").alias("host"), F.col("size").alias("host_size")), "doc_id").where((F.col("pre") > F.col("host")) & (F.col("pre") <= F.col("host") + F.col("host_size")))
                rule = f"{kind} {c.get('name')}"
                if kind == "unique":
                    found.append(constraints.unique(within, ["doc_id", "host"], names, rule))
                elif kind == "key":
                    found.append(constraints.key(within, ["doc_id", "host"], names, rule))
                if kind != "keyref":
                    keys[c.get("name")] = within.select("doc_id", "host", *names)
                else:
                    whole = within.where(F.forall(F.array(*[F.col(n).isNotNull() for n in names]), lambda v: v))
                    found.append(constraints.keyref(whole, names, keys[_local(c.get("refer"))], names, ["doc_id", "host"], rule))


def _parsed(text: str):
    from nodeloom.plans.parser import Parser

    return Parser(text).whole()
