"""Axis steps as joins over the node table. Every join has doc_id as an equi key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.sources.xml import ATTR, ELEM

REVERSE = frozenset(["parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling"])
COLUMNS = ("pre", "size", "level", "parent", "kind", "ns_uri", "local", "sib_ord", "value", "attrs")


def _on(axis: str, c, n) -> Column:
    same, tree = c("doc_id") == n("doc_id"), n("kind") != ATTR
    if axis == "child":
        return same & (n("parent") == c("pre")) & tree
    if axis == "attribute":
        return same & (n("parent") == c("pre")) & (n("kind") == ATTR)
    if axis == "descendant":
        return same & (n("pre") > c("pre")) & (n("pre") <= c("pre") + c("size")) & tree
    if axis == "descendant-or-self":
        return same & n("pre").between(c("pre"), c("pre") + c("size")) & (tree | (n("pre") == c("pre")))
    if axis == "parent":
        return same & (n("pre") == c("parent")) & tree
    if axis == "ancestor":
        return same & (n("pre") < c("pre")) & (c("pre") <= n("pre") + n("size")) & tree
    if axis == "ancestor-or-self":
        return same & (n("pre") <= c("pre")) & (c("pre") <= n("pre") + n("size"))
    if axis == "following-sibling":
        return same & (n("parent") == c("parent")) & (n("pre") > c("pre")) & tree & (c("kind") != ATTR)
    if axis == "preceding-sibling":
        return same & (n("parent") == c("parent")) & (n("pre") < c("pre")) & tree & (c("kind") != ATTR)
    if axis == "following":
        return same & (n("pre") > c("pre") + c("size")) & tree
    if axis == "preceding":
        return same & (n("pre") + n("size") < c("pre")) & tree
    raise ValueError(f"no such axis: {axis}")


def step(context: DataFrame, nodes: DataFrame, axis: str, test: Column | None = None, carry: tuple = ()) -> DataFrame:
    """Nodes on the axis of each context row, with ``ctx`` (the context node) and the columns ``carry``. test: over the node's columns."""
    if axis == "self":
        out = context.withColumn("ctx", F.col("pre"))
        return out.where(test) if test is not None else out
    n = nodes.where(test) if test is not None else nodes
    n = n.select(F.col("doc_id").alias("n_doc_id"), *[F.col(c).alias(f"n_{c}") for c in COLUMNS])
    joined = context.join(n, _on(axis, lambda x: F.col(x), lambda x: F.col(f"n_{x}")))
    return joined.select("doc_id", F.col("pre").alias("ctx"), *carry, *[F.col(f"n_{c}").alias(c) for c in COLUMNS])


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("kind") != ATTR) & (F.col("pre") == 0)).select("doc_id", *COLUMNS)


def innermost(items: DataFrame) -> DataFrame:
    """Nodes of which no other item is a descendant."""
    o = items.select(F.col("doc_id").alias("o_doc"), F.col("pre").alias("o_pre"))
    return items.join(o, (F.col("doc_id") == F.col("o_doc")) & (F.col("o_pre") > F.col("pre")) & (F.col("o_pre") <= F.col("pre") + F.col("size")), "left_anti").dropDuplicates(["doc_id", "pre"])


def outermost(items: DataFrame) -> DataFrame:
    """Nodes of which no other item is an ancestor."""
    o = items.select(F.col("doc_id").alias("o_doc"), F.col("pre").alias("o_pre"), F.col("size").alias("o_size"))
    return items.join(o, (F.col("doc_id") == F.col("o_doc")) & (F.col("o_pre") < F.col("pre")) & (F.col("pre") <= F.col("o_pre") + F.col("o_size")), "left_anti").dropDuplicates(["doc_id", "pre"])


def string_value(items: DataFrame, nodes: DataFrame, carry: tuple = ()) -> DataFrame:
    """``items`` with ``text``: their own value, or for elements the text below in document order."""
    from nodeloom.sources.xml import TEXT

    t = nodes.where(F.col("kind") == TEXT).select(F.col("doc_id").alias("t_doc"), F.col("pre").alias("t_pre"), F.col("value").alias("t_value"))
    # items may hold a node several times, for different contexts
    e = items.where(F.col("kind") <= ELEM).select("doc_id", "pre", "size").dropDuplicates(["doc_id", "pre"])
    joined = e.join(t, (F.col("doc_id") == F.col("t_doc")) & (F.col("t_pre") > F.col("pre")) & (F.col("t_pre") <= F.col("pre") + F.col("size")), "left")
    texts = joined.groupBy("doc_id", "pre").agg(F.sort_array(F.collect_list(F.struct("t_pre", "t_value"))).alias("t"))
    texts = texts.select("doc_id", "pre", F.array_join(F.transform("t", lambda x: F.coalesce(x["t_value"], F.lit(""))), "").alias("below"))
    return items.join(texts, ["doc_id", "pre"], "left").withColumn("text", F.when(F.col("kind") <= ELEM, F.coalesce("below", F.lit(""))).otherwise(F.col("value"))).drop("below")
