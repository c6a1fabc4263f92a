"""Catalogs and inclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.sources.xml import ATTR, DOC, ELEM

XI = "http://www.w3.org/2001/XInclude"


def catalog(uris: DataFrame, entries: DataFrame, column: str = "uri") -> DataFrame:
    """``uris`` with ``resolved``. entries: (kind, name, target) with kinds uri (also system), rewrite (longest start wins) and suffix (longest end wins), in that order; else the URI itself.

    Starts and ends are cut only at the lengths that entries have, so that both are equi joins.
    """
    u = uris.select(F.col(column).alias("__u")).distinct()
    out = None
    for rank, (kind, part) in enumerate((("uri", lambda n: F.col("__u")), ("rewrite", lambda n: F.substring("__u", F.lit(1), n)), ("suffix", lambda n: F.right("__u", n)))):
        e = entries.where(F.col("kind") == kind).select(F.col("name").alias("__n"), "target").groupBy("__n").agg(F.min("target").alias("target"))
        lengths = e.agg(F.collect_set(F.length("__n")).alias("__ls"))
        tried = u.join(F.broadcast(lengths)).select("__u", F.explode("__ls").alias("__l")) if kind != "uri" else u.withColumn("__l", F.length("__u"))
        tried = tried.where(F.col("__l") <= F.length("__u")).select("__u", "__l", part(F.col("__l")).alias("__n"))
        target = F.concat("target", F.substring(F.col("__u"), F.col("__l") + 1, F.length("__u"))) if kind == "rewrite" else F.col("target")
        hit = tried.join(e, "__n").select("__u", F.struct(F.lit(-rank).alias("r"), F.col("__l").alias("l"), target.alias("t")).alias("h"))
        out = hit if out is None else out.unionByName(hit)
    best = out.groupBy("__u").agg(F.max("h").alias("h"))
    found = uris.join(best, F.col(column) == F.col("__u"), "left")
    return found.withColumn("resolved", F.coalesce(F.col("h.t"), F.col(column))).drop("__u", "h")


def include(nodes: DataFrame, by_href: DataFrame) -> DataFrame:
    """XInclude, one level: each ``xi:include`` is replaced by the nodes of the document that ``by_href`` (href, doc_id) gives for it; those without one stay.

    Places are moved by a running sum of the rows that come in less those that go; apply again for inclusions within inclusions.
    """
    el = nodes.where((F.col("kind") == ELEM) & (F.col("ns_uri") == XI) & (F.col("local") == "include")).select("doc_id", "pre", "size", "level", "parent")
    href = nodes.where((F.col("kind") == ATTR) & (F.col("local") == "href")).select("doc_id", F.col("parent").alias("pre"), F.col("value").alias("href"))
    size_of = nodes.where(F.col("kind") == DOC).select(F.col("doc_id").alias("i_doc"), F.col("size").alias("i_size"))
    el = el.join(href, ["doc_id", "pre"]).join(by_href.select("href", F.col("doc_id").alias("i_doc")), "href").join(size_of, "i_doc")
    # whole includes only: one within the fallback of another goes with it
    el = el.select("doc_id", "pre", F.struct("pre", "size", "level", "parent", "i_doc", (F.col("i_size") - F.col("size") - 1).alias("delta")).alias("i"))
    doc = Window.partitionBy("doc_id").orderBy("pre")
    rows = nodes.join(el, ["doc_id", "pre"], "left")
    last = F.max(F.when(F.col("i").isNotNull(), F.col("pre") + F.col("i.size"))).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gone", F.coalesce(last >= F.col("pre"), F.lit(False)))
    delta = F.when(~F.col("gone"), F.coalesce(F.col("i.delta"), F.lit(0))).otherwise(0)
    rows = rows.withColumn("shift", F.coalesce(F.sum(delta).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("shift_in", F.col("shift") + delta)
    base = nodes.columns
    at = rows.select("doc_id", F.col("pre").alias("at"), "shift", F.col("shift_in"))
    ends = at.select("doc_id", F.col("at").alias("end"), F.col("shift_in").alias("end_shift"))
    ups = at.select("doc_id", F.col("at").alias("parent"), F.col("shift").alias("up_shift"))
    kept = rows.where(~F.col("gone") & F.col("i").isNull()).withColumn("end", F.col("pre") + F.col("size"))
    kept = kept.join(ends, ["doc_id", "end"]).join(ups, ["doc_id", "parent"], "left")
    kept = kept.withColumn("size", F.col("size") + F.col("end_shift") - F.col("shift")).withColumn("pre", F.col("pre") + F.col("shift")).withColumn("parent", F.col("parent") + F.col("up_shift")).select(*base)
    slots = rows.where(~F.col("gone") & F.col("i").isNotNull()).select(F.col("doc_id").alias("to_doc"), F.col("i.i_doc").alias("doc_id"), (F.col("pre") + F.col("shift")).alias("to"), F.col("i.level").alias("to_level"), F.col("i.parent").alias("host"))
    slots = slots.join(ups.select(F.col("doc_id").alias("to_doc"), F.col("parent").alias("host"), "up_shift"), ["to_doc", "host"])
    came = nodes.where(F.col("kind") != DOC).join(slots, "doc_id")
    parent = F.when(F.col("parent") == 0, F.col("host") + F.col("up_shift")).otherwise(F.col("to") + F.col("parent") - 1)
    came = came.withColumn("parent", parent).withColumn("pre", F.col("to") + F.col("pre") - 1).withColumn("level", F.col("level") + F.col("to_level") - 1).withColumn("doc_id", F.col("to_doc")).select(*base)
    order = F.row_number().over(Window.partitionBy("doc_id", "parent", F.col("kind") == ATTR).orderBy("pre"))
    return kept.unionByName(came).withColumn("sib_ord", F.when(F.col("kind") != ATTR, order))
