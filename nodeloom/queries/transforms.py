"""Queries of template rules, editing, pointers, schema attributes, reports, digests and encryption."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeloom.operators import constraints, templates
from nodeloom.operators import nodes as of_nodes
from nodeloom.operators.templates import Rule
from nodeloom.plans.xpath import XPath
from nodeloom.queries.paths import attributes
from nodeloom.sources import fixtures, sinks, xml

QUERIES: dict = {}
ORACLE: dict = {}
C, L = F.col, F.lit


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _a(name: str):
    return F.try_element_at("attrs", L(name))


def _rules():
    return [
        Rule("order", F.concat(L("#"), _a("id"), L("[")), L("]")),
        Rule("*", L("?"), descend=False),
        Rule("line", F.concat(_a("ret"), L(";"))),
        Rule("line[@qty > 45]", F.concat(_a("ret"), L("!;"))),
        Rule("line[@ret = 'N']", L(""), priority=2),
    ]


_LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag"


@query(f"SELECT o_orderkey AS doc_id, '#' || o_orderkey || '[' || coalesce(string_agg(CASE WHEN l_returnflag = 'N' THEN '' WHEN l_quantity > 45 THEN l_returnflag || '!;' ELSE l_returnflag || ';' END, '' ORDER BY {_LINE}), '') || ']' AS text FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def apply_templates(spark, sf_dir):
    return templates.transform(fixtures.nodes(spark, sf_dir, "order_xml"), _rules())


@query("SELECT n_name AS name, 2::BIGINT AS rules, 'nation' AS second FROM nation")
def next_match(spark, sf_dir):
    nodes = fixtures.nodes(spark, sf_dir, "geo_xml")
    rules = [Rule("nation"), Rule("region/nation", priority=1), Rule("supplier")]
    found = templates.matches(nodes, rules).join(attributes(nodes, "nation", ["name"]), ["doc_id", "pre"])
    out = found.groupBy("doc_id", "pre", "name").agg(F.count("*").alias("rules"), F.max(F.when(C("rank") == 2, C("rule"))).alias("second"))
    return out.select("name", "rules", F.when(C("second") == 0, "nation").alias("second"))


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 20")
def template_conflicts(spark, sf_dir):
    rules = [Rule("line[@ret = 'R']"), Rule("line[@qty > 20]"), Rule("line")]
    return templates.conflicts(fixtures.nodes(spark, sf_dir, "order_xml"), rules).agg(F.count("*").alias("n"))


@query("SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def built_in_rules(spark, sf_dir):
    """Without rules of one's own all text comes through."""
    return templates.transform(fixtures.nodes(spark, sf_dir, "talk_xml"), [Rule("no-such-element")])


@query("SELECT o_orderkey AS doc_id, 7 + count(l_orderkey) FILTER (l_returnflag <> 'R') * 8 AS size, count(l_orderkey) FILTER (l_returnflag <> 'R') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def tree_unlink(spark, sf_dir):
    nodes = fixtures.nodes(spark, sf_dir, "order_xml")
    # the new tree is stored, as every node table is: its paths would else edit the documents anew for each step
    kept = fixtures.Results(spark, nodes.buckets)
    kept.add(templates.unlink(nodes, XPath(nodes).select("//line[@ret = 'R']")).where(C("kind") != xml.ATTR))
    out = kept.table()
    size = out.where(C("kind") == xml.DOC).select("doc_id", "size")
    lines = XPath(out).select("/order/line").groupBy("doc_id").agg(F.count("*").alias("lines"))
    return size.join(lines, "doc_id", "left").select("doc_id", "size", F.coalesce("lines", L(0)).cast("long").alias("lines"))


@query("SELECT n_nationkey::BIGINT AS id, lower(n_name) AS name FROM nation")
def tree_set_attribute(spark, sf_dir):
    nodes = fixtures.nodes(spark, sf_dir, "geo_xml")
    new = attributes(nodes, "nation", ["name"]).select("doc_id", "pre", F.lower("name").alias("new_value"))
    return attributes(templates.set_attribute(nodes, new, "name"), "nation", ["id", "name"]).select(C("id").cast("long").alias("id"), "name")


@query("SELECT n_name AS name, 3 + count(s_suppkey) * 3 AS subtree, 7 + count(s_suppkey) * 3 AS snapshot FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def copy_and_snapshot(spark, sf_dir):
    """A nation's own rows, and with them world, region and the region's two attributes and the document."""
    nodes = fixtures.nodes(spark, sf_dir, "geo_xml")
    nation = XPath(nodes).select("//nation")
    count = lambda up, name: templates.copy_of(nodes, nation, up).groupBy("doc_id", "root").agg(F.count("*").alias(name))
    names = attributes(nodes, "nation", ["name"]).withColumnRenamed("pre", "root").select("doc_id", "root", "name")
    both = count(False, "subtree").join(count(True, "snapshot"), ["doc_id", "root"]).join(names, ["doc_id", "root"])
    return both.select("name", "subtree", (C("snapshot") - 1).alias("snapshot"))


@query("SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = (SELECT min(r_regionkey) FROM region) ORDER BY n_nationkey LIMIT 1 OFFSET 1")
def xpointer_element(spark, sf_dir):
    nodes = fixtures.nodes(spark, sf_dir, "geo_xml")
    return attributes(nodes, "nation", ["name"]).join(templates.pointer(nodes, "element(/1/1/2)"), ["doc_id", "pre"], "left_semi").select("name")


@query("SELECT rule, n FROM (SELECT 'required note' AS rule, count(*) AS n FROM orders UNION ALL SELECT 'prohibited total', count(*) FROM orders UNION ALL SELECT 'fixed status', count(*) FILTER (o_orderstatus <> 'F') FROM orders UNION ALL SELECT 'undeclared date', count(*) FROM orders) WHERE n > 0")
def schema_attributes(spark, sf_dir):
    bad = constraints.attribute_use(fixtures.nodes(spark, sf_dir, "order_xml"), "order", required=["id", "note"], prohibited=["total"], fixed={"status": "F"}, allowed=["cust", "priority", "total"])
    return bad.groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, (s_suppkey * 7)::VARCHAR AS missing FROM supplier WHERE s_suppkey * 7 NOT IN (SELECT s_suppkey FROM supplier)")
def schema_idref(spark, sf_dir):
    nodes = fixtures.nodes(spark, sf_dir, "geo_xml")
    supplier = attributes(nodes, "supplier", ["id"])
    only = nodes.join(supplier.select("doc_id", C("pre").alias("parent")), ["doc_id", "parent"], "left_semi")
    refs = supplier.select("doc_id", "pre", (C("id").cast("long") * 7).cast("string").alias("value"))
    bad = constraints.idrefs(refs, of_nodes.ids(only, ["id"]))
    return bad.join(supplier, ["doc_id", "pre"]).select(C("id").cast("long").alias("id"), C("message").alias("missing"))


@query("SELECT rule, message, count(*) AS n FROM (SELECT 'late' AS rule, 'order in ' || year(o_orderdate) AS message FROM orders WHERE year(o_orderdate) >= 1997 UNION ALL SELECT 'dear', 'costs over 300000' FROM orders WHERE o_totalprice > 300000) GROUP BY ALL")
def schematron_reports(spark, sf_dir):
    o = attributes(fixtures.nodes(spark, sf_dir, "order_xml"), "order", ["date", "total"])
    out = constraints.reports(
        o, {"year": F.substring("date", 1, 4), "limit": L(300000)},
        late=(C("year") >= "1997", F.concat(L("order in "), "year")), dear=(C("total").cast("double") > C("limit"), F.concat(L("costs over "), C("limit").cast("string"))),
    )
    return out.groupBy("rule", "message").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT conv_id AS doc_id, true AS same, true AS changed FROM conversations")
def digest_and_encryption(spark, sf_dir):
    """Digest of the canonical form, and AES-GCM there and back; the key is a fixture's."""
    c = sinks.serialize(fixtures.nodes(spark, sf_dir, "talk_xml"), canonical=True)
    key = L("0123456789abcdef")
    hidden = F.aes_encrypt(C("xml"), key, L("GCM"))
    back = F.decode(F.aes_decrypt(hidden, key, L("GCM")), "UTF-8")
    return c.select("doc_id", (F.sha2(back, 256) == F.sha2("xml", 256)).alias("same"), (F.sha2(F.concat("xml", L(" ")), 256) != F.sha2("xml", 256)).alias("changed"))
