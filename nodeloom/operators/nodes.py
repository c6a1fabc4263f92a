"""Functions of nodes: paths, identifiers, languages, namespaces in scope, digests for deep equality, comparisons of two paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.sources.xml import ATTR, COMMENT, DOC, ELEM, PI, TEXT

XML_NS = "http://www.w3.org/XML/1998/namespace"


def generate_id(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("id", F.concat(F.lit("d"), F.col("doc_id"), F.lit("n"), F.col("pre")))


def paths(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, path): fn:path of the context's elements, attributes, texts, comments and instructions. Only elements are looked for above; with the columns of a node, an attribute names itself."""
    number = lambda *by: F.concat(F.lit("["), F.row_number().over(Window.partitionBy("doc_id", "parent", *by).orderBy("pre")), F.lit("]"))
    uri = F.coalesce("ns_uri", F.lit(""))
    name = F.concat(F.lit("Q{"), uri, F.lit("}"), "local")
    of_attribute = F.concat(F.lit("@"), F.when(uri == "", F.col("local")).otherwise(name))
    above = nodes.where(F.col("kind") == ELEM).select("doc_id", F.col("pre").alias("a_pre"), F.col("size").alias("a_size"), F.concat(name, number("ns_uri", "local")).alias("step"))
    leaves = nodes.where(F.col("kind").isin(TEXT, COMMENT))
    leaves = leaves.select("doc_id", "pre", F.concat(F.when(F.col("kind") == TEXT, "text()").otherwise("comment()"), number("kind")).alias("own"))
    asked = nodes.where(F.col("kind") == PI).select("doc_id", "pre", F.concat(F.lit("processing-instruction("), "local", F.lit(")"), number("local")).alias("own"))
    leaves = leaves.unionByName(asked)
    known = {"kind", "ns_uri", "local"} <= set(context.columns)
    c = context.select("doc_id", "pre", F.when(F.col("kind") == ATTR, of_attribute).alias("named")) if known else context.select("doc_id", "pre")
    if not known:
        c = c.join(nodes.where(F.col("kind") == ATTR).select("doc_id", "pre", of_attribute.alias("named")), ["doc_id", "pre"], "left")
    found = c.select("doc_id", "pre").join(above, "doc_id").where((F.col("a_pre") <= F.col("pre")) & (F.col("pre") <= F.col("a_pre") + F.col("a_size")))
    found = found.groupBy("doc_id", "pre").agg(F.sort_array(F.collect_set(F.struct("a_pre", "step"))).alias("s"))
    rows = c.join(found, ["doc_id", "pre"], "left").join(leaves, ["doc_id", "pre"], "left")
    own = F.array_compact(F.array(F.coalesce("named", "own")))
    return rows.select("doc_id", "pre", F.concat(F.lit("/"), F.array_join(F.concat(F.coalesce(F.col("s.step"), F.array().cast("array<string>")), own), "/")).alias("path"))


def ids(nodes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(doc_id, id, pre): elements by xml:id or by an attribute called one of ``names``; of repeated ids the first element counts."""
    named = (F.col("ns_uri") == XML_NS) & (F.col("local") == "id")
    if names:
        named = named | F.col("local").isin(*names)
    found = nodes.where((F.col("kind") == ATTR) & named).select("doc_id", F.trim("value").alias("id"), F.col("parent").alias("pre"))
    return found.groupBy("doc_id", "id").agg(F.min("pre").alias("pre"))


def by_id(refs: DataFrame, id_table: DataFrame, column: str = "value") -> DataFrame:
    """fn:id: each white-space separated word of the column finds its element; (doc_id, pre), once each."""
    words = refs.select("doc_id", F.explode(F.split(F.trim(F.col(column)), "[ \t\r\n]+")).alias("id"))
    return words.join(id_table, ["doc_id", "id"]).select("doc_id", "pre").distinct()


def languages(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, lang): xml:lang of the nearest element at or above; null if there is none."""
    marks = nodes.where((F.col("kind") == ATTR) & (F.col("ns_uri") == XML_NS) & (F.col("local") == "lang")).select("doc_id", F.col("parent").alias("l_pre"), F.col("value").alias("lang"))
    reach = nodes.where(F.col("kind") == ELEM).select("doc_id", F.col("pre").alias("l_pre"), F.col("size").alias("l_size"))
    marks = marks.join(reach, ["doc_id", "l_pre"])
    c = context.select("doc_id", "pre")
    found = c.join(marks, "doc_id").where(F.col("pre").between(F.col("l_pre"), F.col("l_pre") + F.col("l_size")))
    return c.join(found.groupBy("doc_id", "pre").agg(F.max_by("lang", "l_pre").alias("lang")), ["doc_id", "pre"], "left")


def is_lang(column, wanted: str):
    """fn:lang: the language or a sublanguage of it, without regard to case."""
    have = F.lower(column)
    return F.coalesce((have == wanted.lower()) | have.startswith(wanted.lower() + "-"), F.lit(False))


def namespaces(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, prefix, uri): the namespaces in scope, declared at or above the node, the nearest for each prefix, and ``xml``."""
    declared = nodes.where((F.col("kind") == ELEM) & F.col("declared").isNotNull())
    used = declared.select("doc_id", F.col("pre").alias("n_pre"), F.col("size").alias("n_size"), F.explode("declared").alias("prefix", "uri"))
    c = context.select("doc_id", "pre")
    found = c.join(used, "doc_id").where(F.col("pre").between(F.col("n_pre"), F.col("n_pre") + F.col("n_size")))
    near = found.groupBy("doc_id", "pre", "prefix").agg(F.max_by("uri", "n_pre").alias("uri")).where("uri <> ''")
    xml_ = c.select("doc_id", "pre", F.lit("xml").alias("prefix"), F.lit(XML_NS).alias("uri"))
    return near.unionByName(xml_).dropDuplicates(["doc_id", "pre", "prefix"])


def digests(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, digest): equal for deep-equal elements. Names, attributes in any order and texts count; comments and instructions don't."""
    own = nodes.where(F.col("kind").isin(ELEM, ATTR, TEXT))
    c = context.select("doc_id", F.col("pre").alias("c_pre"), F.col("size").alias("c_size"), F.col("level").alias("c_level"))
    below = c.join(own, "doc_id").where(F.col("pre").between(F.col("c_pre"), F.col("c_pre") + F.col("c_size")))
    name = F.concat(F.coalesce("ns_uri", F.lit("")), F.lit("\x00"), F.coalesce("local", F.lit("")))
    depth = F.col("level") - F.col("c_level")
    # attributes are ordered by name within their element, everything else by place
    attr = F.col("kind") == ATTR
    place = F.when(attr, F.col("parent")).otherwise(F.col("pre"))
    item = F.struct(place.alias("p"), F.when(attr, name).otherwise("").alias("n"), F.concat_ws("\x01", "kind", depth, name, F.coalesce("value", F.lit(""))).alias("t"))
    return below.groupBy("doc_id", F.col("c_pre").alias("pre")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["t"]), "\x02"), 256).alias("digest"))
