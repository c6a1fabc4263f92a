"""Template rules over a node table.

A rule has a pattern, and texts to write where a node that it wins begins and ends; the node's children are processed in between
unless the rule stops there. The winner of a node is found by one ranking of all matches, and the result is the pieces in document order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.plans import axes
from nodeloom.plans.xpath import XPath
from nodeloom.sources.xml import ATTR, COMMENT, DOC, ELEM, PI, TEXT


@dataclass(frozen=True)
class Rule:
    """match: a path without a start (``line``, ``order/line[@ret = 'R']``) or from the root. opening and closing are Columns over the node's columns and ``attrs``, a map of its attributes."""

    match: str
    opening: Column | None = None
    closing: Column | None = None
    descend: bool = True
    priority: float | None = None
    precedence: int = 0
    mode: str | None = None


def default_priority(match: str) -> float:
    """0.5 for paths and predicates, -0.5 for ``*``, ``node()`` and kind tests, -0.25 for any name of one namespace, 0 for a name."""
    if "/" in match or "[" in match:
        return 0.5
    name = match.removeprefix("@")
    return -0.25 if name.endswith(":*") else -0.5 if name == "*" or name.endswith("()") else 0.0


def matches(nodes: DataFrame, rules: list[Rule], mode: str | None = None, namespaces: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, pre, rule, rank): every rule of the mode that matches, best first: import precedence, then priority, then the later rule. Rank 2 is what next-match takes."""
    x, found = XPath(nodes, namespaces), None
    for i, r in enumerate(rules):
        if r.mode != mode:
            continue
        priority = default_priority(r.match) if r.priority is None else r.priority
        rows = x.select(r.match if r.match.startswith("/") else f"//{r.match}").select("doc_id", "pre", F.lit(i).alias("rule"), F.struct(F.lit(r.precedence).alias("a"), F.lit(priority).alias("b"), F.lit(i).alias("c")).alias("by"))
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("doc_id", "pre").orderBy(F.col("by").desc())
    return found.withColumn("rank", F.row_number().over(order)).drop("by")


def conflicts(nodes: DataFrame, rules: list[Rule], mode: str | None = None) -> DataFrame:
    """Nodes that two rules of one precedence and priority match, for on-multiple-match="fail"."""
    strength = [(r.precedence, default_priority(r.match) if r.priority is None else r.priority) for r in rules]
    of = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(float(b)).alias("b")) for a, b in strength]), F.col("rule") + 1)
    best = matches(nodes, rules, mode).withColumn("by", of)
    top = best.groupBy("doc_id", "pre").agg(F.max("by").alias("top"))
    return best.join(top, ["doc_id", "pre"]).where("by = top").groupBy("doc_id", "pre").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "pre")


def transform(nodes: DataFrame, rules: list[Rule], mode: str | None = None, no_match: str = "text-only-copy", namespaces: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text). no_match, for nodes without a rule: text-only-copy, shallow-skip, deep-skip or deep-copy-text."""
    best = matches(nodes, rules, mode, namespaces).where("rank = 1").drop("rank")
    rows = nodes.where(F.col("kind") != ATTR).join(best, ["doc_id", "pre"], "left")
    builtin = F.when(F.col("kind") == TEXT, F.col("value")).otherwise("") if no_match in ("text-only-copy", "deep-copy-text") else F.lit("")
    opening, closing, descend = builtin, F.lit(""), F.lit(no_match != "deep-skip") | (F.col("kind") == DOC)
    for i, r in enumerate(rules):
        mine = F.coalesce(F.col("rule") == i, F.lit(False))
        opening = F.when(mine, r.opening if r.opening is not None else F.lit("")).otherwise(opening)
        closing = F.when(mine, r.closing if r.closing is not None else F.lit("")).otherwise(closing)
        descend = F.when(mine, r.descend).otherwise(descend)
    rows = rows.select("doc_id", "pre", "size", "level", F.coalesce(opening, F.lit("")).alias("opening"), F.coalesce(closing, F.lit("")).alias("closing"), descend.alias("descend"))
    # what lies within a node that stops: the furthest reach of earlier stops is a running maximum
    before = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(~F.col("descend"), F.col("pre") + F.col("size"))).over(before)
    rows = rows.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("reach") < F.col("pre")))
    start = F.struct((F.col("pre") * 2).alias("at"), F.lit(0).alias("depth"), F.col("opening").alias("text"))
    end = F.struct(((F.col("pre") + F.col("size")) * 2 + 1).alias("at"), (-F.col("level")).alias("depth"), F.col("closing").alias("text"))
    pieces = rows.select("doc_id", F.explode(F.array(start, end)).alias("p"))
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("p.text") != "") | (F.col("p.at") == 0), F.col("p")))), lambda p: p["text"]), "").alias("text"))


# -- editing and copying ------------------------------------------------------------------------


def renumber(nodes: DataFrame) -> DataFrame:
    """Places, sizes and parents anew after rows went: old places still nest, so counting starts up to each end gives the sizes.

    Rows of attributes take no part in the counting: an element counts for as many rows as its map ``attrs`` has entries, and one more.
    """
    rows = nodes.where(F.col("kind") != ATTR)
    weight = F.when(F.col("attrs").isNull(), 1).otherwise(F.size("attrs") + 1)
    start = F.struct((F.col("pre") * 2).alias("at"), F.lit(0).alias("depth"), weight.alias("n"))
    end = F.struct(((F.col("pre") + F.col("size")) * 2 + 1).alias("at"), (-F.col("level")).alias("depth"), F.lit(0).alias("n"))
    events = rows.select("doc_id", "pre", F.explode(F.array(start, end)).alias("e")).select("doc_id", "pre", "e.*")
    w = Window.partitionBy("doc_id").orderBy("at", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("seen", F.sum("n").over(w))
    place = events.groupBy("doc_id", "pre").agg(F.max(F.when(F.col("n") > 0, F.col("seen") - F.col("n"))).alias("new_pre"), F.max("seen").alias("last"))
    up = place.select("doc_id", F.col("pre").alias("parent"), F.col("new_pre").alias("new_parent"))
    rows = rows.join(place, ["doc_id", "pre"]).join(up, ["doc_id", "parent"], "left")
    rows = rows.withColumn("pre", F.col("new_pre")).withColumn("size", F.col("last") - F.col("new_pre") - 1).withColumn("parent", F.col("new_parent"))
    order = Window.partitionBy("doc_id", "parent").orderBy("pre")
    rows = rows.withColumn("sib_ord", F.row_number().over(order))
    held = nodes.where(F.col("kind") == ATTR).join(up, ["doc_id", "parent"])
    held = held.withColumn("pre", F.col("new_parent") + F.row_number().over(order)).withColumn("parent", F.col("new_parent")).withColumn("kind", F.lit(ATTR))
    return rows.select(*nodes.columns).unionByName(held.select(*nodes.columns))


def unlink(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The documents without the subtrees of ``targets`` (doc_id, pre; with kind, parent, ns_uri and local, as paths give them, no row of an attribute is read to find those that go)."""
    cut = targets.select("doc_id", "pre", F.lit(True).alias("__cut")).distinct()
    away = targets if {"kind", "parent", "ns_uri", "local"} <= set(targets.columns) else nodes.join(cut, ["doc_id", "pre"], "left_semi")
    away = away.where(F.col("kind") == ATTR)
    # attributes that go also leave the maps of their elements
    gone = away.groupBy("doc_id", F.col("parent").alias("pre")).agg(F.collect_set(_attribute_key()).alias("__gone"))
    rows = nodes.where(F.col("kind") != ATTR).join(cut, ["doc_id", "pre"], "left").join(gone, ["doc_id", "pre"], "left")
    rows = rows.withColumn("attrs", F.when(F.col("__gone").isNull(), F.col("attrs")).otherwise(F.map_filter("attrs", lambda k, _: ~F.array_contains("__gone", k))))
    upto = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__reach", F.max(F.when(F.col("__cut"), F.col("pre") + F.col("size"))).over(upto))
    rows = rows.where(F.col("__reach").isNull() | (F.col("__reach") < F.col("pre"))).select(*nodes.columns)
    # the attributes of what went find no element in ``renumber``
    held = nodes.where(F.col("kind") == ATTR).join(away.select("doc_id", "pre"), ["doc_id", "pre"], "left_anti").withColumn("kind", F.lit(ATTR))
    return renumber(rows.unionByName(held.select(*nodes.columns)))


def _attribute_key() -> F.Column:
    return F.when(F.coalesce("ns_uri", F.lit("")) == "", F.col("local")).otherwise(F.concat(F.lit("{"), "ns_uri", F.lit("}"), "local"))


def set_attribute(nodes: DataFrame, targets: DataFrame, local: str, value: str = "new_value") -> DataFrame:
    """Values of existing attributes called ``local`` of the elements in ``targets`` (doc_id, pre, and the column ``value``)."""
    t = targets.select("doc_id", F.col("pre").alias("__owner"), F.col(value).alias("__new"), F.lit(True).alias("__set")).dropDuplicates(["doc_id", "__owner"])
    rows = nodes.withColumn("__owner", F.when(F.col("kind") == ATTR, F.col("parent")).otherwise(F.col("pre"))).join(t, ["doc_id", "__owner"], "left")
    hit = F.coalesce("__set", F.lit(False))
    there = hit & F.coalesce(F.map_contains_key("attrs", local), F.lit(False))
    rows = rows.withColumn("value", F.when(hit & (F.col("kind") == ATTR) & (F.col("local") == local), F.col("__new")).otherwise(F.col("value")))
    return rows.withColumn("attrs", F.when(there, F.transform_values("attrs", lambda k, v: F.when(k == local, F.col("__new")).otherwise(v))).otherwise(F.col("attrs"))).select(*nodes.columns)


def copy_of(nodes: DataFrame, targets: DataFrame, ancestors: bool = False) -> DataFrame:
    """Rows of the subtrees of ``targets`` with ``root``, the target's place; ancestors: with the elements above and their attributes, as fn:snapshot gives."""
    t = targets.select("doc_id", F.col("pre").alias("root"), F.col("size").alias("root_size"))
    rows = nodes.join(t, "doc_id")
    inside = F.col("pre").between(F.col("root"), F.col("root") + F.col("root_size"))
    if ancestors:
        above = lambda place, size: (place < F.col("root")) & (F.col("root") <= place + size)
        reach = nodes.select("doc_id", F.col("pre").alias("parent"), F.col("size").alias("up_size"))
        rows = rows.join(reach, ["doc_id", "parent"], "left")
        inside = inside | F.when(F.col("kind") == ATTR, above(F.col("parent"), F.col("up_size"))).otherwise(above(F.col("pre"), F.col("size")))
    return rows.where(F.coalesce(inside, F.lit(False))).select("root", *nodes.columns)


def pointer(nodes: DataFrame, expression: str, id_table: DataFrame | None = None) -> DataFrame:
    """XPointer: a shorthand id, ``element(id/1/2)``, ``element(/1/2)`` or ``xpointer(path)``."""
    scheme, _, rest = expression.partition("(")
    if not rest:
        scheme, rest = "element", expression + ")"
    body = rest.removesuffix(")")
    if scheme == "xpointer":
        return XPath(nodes).select(body)
    if scheme != "element":
        raise ValueError(f"this pointer scheme is not known: {scheme}")
    first, *steps = body.split("/")
    now = nodes.join(id_table.where(F.col("id") == first).select("doc_id", "pre"), ["doc_id", "pre"], "left_semi") if first else axes.roots(nodes)
    element = nodes.where(F.col("kind") == ELEM)
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("pre"))
    numbered = element.withColumn("__n", ordinal)
    for step in steps:
        now = numbered.where(F.col("__n") == int(step)).drop("__n").join(now.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"], "left_semi")
    return now.select("doc_id", *axes.COLUMNS)


KINDS = {"document": DOC, "element": ELEM, "attribute": ATTR, "text": TEXT, "comment": COMMENT, "processing-instruction": PI}
