"""What keeps plans and generated code small as tables grow."""

import pytest
from pyspark.sql import functions as F

from nodeloom.functions import values
from nodeloom.operators import nodes as of_nodes
from nodeloom.operators import templates
from nodeloom.plans.xpath import XPath, compare, number_of
from nodeloom.plans.xslt import Stylesheet
from nodeloom.sources import fixtures, xml

SF = "/root/testdata/sf0.001"
XSLT = '<xsl:stylesheet version="3.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform">{}</xsl:stylesheet>'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("path", ["/order/line", "//line[2]", "//line[@ret = 'R']", "//line[../line/@qty > 49]", "/order/line/@*", "//line/@qty/ancestor::*"])
def test_steps_within_documents_need_no_exchange(spark, path):
    found = XPath(fixtures.nodes(spark, SF, "order_xml")).select(path).groupBy("doc_id").count()
    assert "Exchange hashpartitioning" not in plan(found)


def test_elements_are_read_without_rows_of_attributes(spark):
    assert "Union" not in plan(XPath(fixtures.nodes(spark, SF, "order_xml")).select("//line"))


def test_stored_attributes_keep_names_and_places(spark, tmp_path):
    docs = spark.createDataFrame([(1, '<p:a xmlns:p="urn:p" x="1" p:y="2"><b z="3"/>t</p:a>')], "doc_id long, xml string")
    columns = ["doc_id", "pre", "size", "level", "parent", "kind", "ns_uri", "local", "prefix", "sib_ord", "value", "attrs"]
    xml.trees(docs).write.parquet(str(tmp_path / "t"))
    stored = xml.node_table(spark.read.parquet(str(tmp_path / "t"))).select(columns).orderBy("pre").collect()
    assert stored == xml.shred(docs).select(columns).orderBy("pre").collect()
    assert [tuple(r[5:9]) for r in stored if r["kind"] == xml.ATTR] == [(2, "", "x", ""), (2, "urn:p", "y", "p"), (2, "", "z", "")]


@pytest.mark.parametrize("op, want", [("lt", [True, False, False]), ("gt", [False, False, False]), ("ne", [True, True, True]), ("eq", [False, False, False]), ("ge", [False, False, False])])
def test_numbers_compare_briefly(spark, op, want):
    rows = spark.createDataFrame([(0, "1", "INF"), (1, "x", "2"), (2, "y", "z")], "i long, a string, b string")
    holds = compare(op, number_of(F.col("a"), "untyped"), number_of(F.col("b"), "untyped"), True)
    assert [r["h"] for r in rows.select("i", holds.alias("h")).orderBy("i").collect()] == want
    assert rows.select(holds)._jdf.queryExecution().optimizedPlan().toString().count("try_cast") <= 4


def test_durations_are_matched_once(spark):
    d = spark.createDataFrame([("-P1Y2M3DT4H5M6.5S",), ("P",), (None,), (" PT1S ",)], "t string").select(values.duration(F.col("t")).alias("d"))
    assert [(r["d"]["months"], float(r["d"]["seconds"])) if r["d"] else None for r in d.collect()] == [(-14, -273906.5), None, None, (0, 1.0)]
    assert plan(d.select(values.duration_text(F.col("d")))).count("regexp_extract") == 0


def test_unlink_of_elements_and_attributes(spark):
    nodes = xml.shred(spark.createDataFrame([(1, "<a x='1' y='2'><b z='3'><c/></b>t<d w='4'/></a>")], "doc_id long, xml string"))
    targets = XPath(nodes).select("//b | //@x")
    for t in (targets, targets.select("doc_id", "pre")):
        out = templates.unlink(nodes, t).orderBy("pre").collect()
        assert [(r["pre"], r["size"], r["parent"], r["kind"], r["local"], r["sib_ord"]) for r in out] == [
            (0, 5, None, 0, None, 1), (1, 4, 0, 1, "a", 1), (2, 0, 1, 2, "y", None), (3, 0, 1, 3, None, 1), (4, 1, 1, 1, "d", 2), (5, 0, 4, 2, "w", None)]
        assert out[1]["attrs"] == {"y": "2"}


def test_paths_of_all_kinds(spark):
    nodes = xml.shred(spark.createDataFrame([(1, "<a x='1'><b/>t<b><!--c--><?p q?></b></a>")], "doc_id long, xml string"))
    want = ["/", "/Q{}a[1]", "/Q{}a[1]/@x", "/Q{}a[1]/Q{}b[1]", "/Q{}a[1]/text()[1]", "/Q{}a[1]/Q{}b[2]", "/Q{}a[1]/Q{}b[2]/comment()[1]", "/Q{}a[1]/Q{}b[2]/processing-instruction(p)[1]"]
    for context in (nodes, nodes.select("doc_id", "pre")):
        assert [r["path"] for r in of_nodes.paths(context, nodes).orderBy("pre").collect()] == want


def test_stylesheet_transforms_attributes_only_if_they_are_selected(spark):
    nodes = xml.shred(spark.createDataFrame([(1, "<a x='1'><b y='2'/></a>")], "doc_id long, xml string"))
    plain = Stylesheet(XSLT.format("<xsl:template match='b'><c/></xsl:template>"))
    assert plain.transform(nodes).first()["text"] == "<c/>" and not plain.to_attributes
    asked = Stylesheet(XSLT.format("<xsl:template match='*'><xsl:apply-templates select='@* | *'/></xsl:template><xsl:template match='@y'>y</xsl:template>"))
    assert asked.transform(nodes).first()["text"] == "1y" and asked.to_attributes
