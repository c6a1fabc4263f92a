"""Node tables back to text: XML, canonical XML, and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.sources.xml import ATTR, COMMENT, DOC, ELEM, PI, TEXT


def _replace(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_TEXT = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#xD;"))
_ATTR = (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;"))


def serialize(nodes: DataFrame, canonical: bool = False) -> DataFrame:
    """(doc_id, xml): each document's rows as pieces of text, joined in document order.

    Start tags take in their attributes (in canonical form sorted by namespace and name), empty elements are
    closed at once or, in canonical form, by an end tag; comments are left out of the canonical form.
    Namespace declarations are written where they stand, in the canonical form by prefix and only where the element above
    does not have the same one in force. Top-level instructions of the canonical form stand on lines of their own.
    """
    name = F.when(F.coalesce("prefix", F.lit("")) != "", F.concat("prefix", F.lit(":"), "local")).otherwise(F.col("local"))
    attr = nodes.where(F.col("kind") == ATTR).select(
        "doc_id", F.col("parent").alias("pre"), F.struct(*([F.col("ns_uri"), F.col("local")] if canonical else [F.col("pre"), F.col("local")]), F.concat(F.lit(" "), name, F.lit('="'), _replace(F.col("value"), _ATTR), F.lit('"')).alias("a_text")).alias("a")
    )
    attr = attr.groupBy("doc_id", "pre").agg(F.sort_array(F.collect_list("a")).alias("held"), F.count("*").alias("n_attrs"))
    rows = nodes.where(F.col("kind") != ATTR).drop("attrs").withColumn("name", name).join(attr, ["doc_id", "pre"], "left")
    shown = F.map_entries("declared")
    if canonical:
        rows = _without_repeats(rows)
        root = nodes.where((F.col("kind") == ELEM) & (F.col("level") == 1)).select("doc_id", F.col("pre").alias("root_pre"))
        rows = rows.join(root, "doc_id", "left")
        shown = F.array_sort(F.map_entries("declared"))
    one = lambda d: F.concat(F.lit(" xmlns"), F.when(d["key"] != "", F.concat(F.lit(":"), d["key"])).otherwise(""), F.lit('="'), _replace(d["value"], _ATTR), F.lit('"'))
    declared = F.coalesce(F.array_join(F.transform(shown, one), ""), F.lit(""))
    attrs = F.coalesce(F.array_join(F.col("held.a_text"), ""), F.lit(""))
    empty = F.col("size") == F.coalesce("n_attrs", F.lit(0))
    top = F.col("level") == 1
    ahead = [F.when(top & (F.col("pre") > F.col("root_pre")), "\n").otherwise("")] if canonical else []
    after = [F.when(top & (F.col("pre") < F.col("root_pre")), "\n").otherwise("")] if canonical else []
    close = F.lit(">") if canonical else F.when(empty, "/>").otherwise(">")
    opening = (
        F.when(F.col("kind") == ELEM, F.concat(F.lit("<"), "name", declared, attrs, close))
        .when(F.col("kind") == TEXT, _replace(F.col("value"), _TEXT))
        .when(F.col("kind") == COMMENT, F.lit("") if canonical else F.concat(F.lit("<!--"), "value", F.lit("-->")))
        .when(F.col("kind") == PI, F.concat(*ahead, F.lit("<?"), "local", F.when(F.col("value") != "", F.concat(F.lit(" "), "value")).otherwise(""), F.lit("?>"), *after))
        .otherwise("")
    )
    start = F.struct((F.col("pre") * 2).alias("at"), F.lit(0).alias("depth"), opening.alias("text"))
    end = F.struct(((F.col("pre") + F.col("size")) * 2 + 1).alias("at"), (-F.col("level")).alias("depth"), F.concat(F.lit("</"), "name", F.lit(">")).alias("text"))
    ends = (F.col("kind") == ELEM) if canonical else (F.col("kind") == ELEM) & ~empty
    pieces = rows.where(F.col("kind") != DOC).select("doc_id", F.explode(F.when(ends, F.array(start, end)).otherwise(F.array(start))).alias("p"))
    return pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select("doc_id", F.array_join(F.col("p.text"), "").alias("xml"))


def _without_repeats(rows: DataFrame) -> DataFrame:
    """``declared`` without what the nearest element above that declares the prefix says too (at the top: without an empty default namespace)."""
    own = rows.where(F.col("declared").isNotNull()).select("doc_id", "pre", "size", F.explode("declared").alias("prefix", "uri"))
    up = own.select("doc_id", "prefix", F.col("pre").alias("u_pre"), F.col("size").alias("u_size"), F.col("uri").alias("u_uri"))
    near = own.join(up, ["doc_id", "prefix"], "left").where(F.col("u_pre").isNull() | (F.col("u_pre") <= F.col("pre")) & (F.col("pre") <= F.col("u_pre") + F.col("u_size")))
    near = near.groupBy("doc_id", "pre", "prefix", "uri").agg(F.max_by(F.when(F.col("u_pre") < F.col("pre"), F.col("u_uri")), F.when(F.col("u_pre") < F.col("pre"), F.col("u_pre"))).alias("above"))
    kept = near.where(F.coalesce("above", F.lit("")) != F.col("uri")).groupBy("doc_id", "pre").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "uri"))).alias("kept"))
    return rows.join(kept, ["doc_id", "pre"], "left").withColumn("declared", F.col("kept")).drop("kept")


def to_json(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, json) of each element: its name, attributes as an object, and its own text."""
    attr = nodes.where(F.col("kind") == ATTR).groupBy("doc_id", F.col("parent").alias("pre")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("local", "value")))).alias("attributes"))
    text = nodes.where(F.col("kind") == TEXT).groupBy("doc_id", F.col("parent").alias("pre")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), "").alias("text"))
    rows = nodes.where(F.col("kind") == ELEM).select("doc_id", "pre", F.col("local").alias("name")).join(attr, ["doc_id", "pre"], "left").join(text, ["doc_id", "pre"], "left")
    return rows.select("doc_id", "pre", F.to_json(F.struct("name", "attributes", "text")).alias("json"))


def result_documents(rows: DataFrame, path: str, href: str = "href") -> None:
    """Secondary results: one folder for each value of ``href``."""
    rows.write.partitionBy(href).mode("error").json(path)


def element_pairs(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, previous, following): neighbours among siblings, by lag and lead instead of sibling joins."""
    w = Window.partitionBy("doc_id", "parent").orderBy("pre")
    return nodes.where(F.col("kind") == ELEM).select("doc_id", "pre", F.lag("pre").over(w).alias("previous"), F.lead("pre").over(w).alias("following"))
