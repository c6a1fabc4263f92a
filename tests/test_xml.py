"""Parsing, output, and paths on small documents."""

import pytest
from pyspark.sql import functions as F

from nodeloom.plans.xpath import XPath, tokens
from nodeloom.sources import sinks, xml
from nodeloom.streaming import documents

DOC = '<a x="1" y="&lt;&quot;"><b>one</b><!-- c --><b>two<c/></b>tail &amp; end<?go now?></a>'


def shredded(spark, *texts, **options):
    return xml.shred(spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string"), **options).cache()


def test_pre_size_level():
    rows, facts = xml.parse_xml(7, DOC)
    assert facts["wellformed"]
    assert [r[1] for r in rows] == list(range(len(rows)))
    by_local = {r[7]: r for r in rows if r[5] == xml.ELEM}
    assert by_local["a"][2] == len(rows) - 2 and by_local["c"][2] == 0 and by_local["c"][3] == 3


def test_round_trip(spark):
    assert sinks.serialize(shredded(spark, DOC)).first()["xml"] == DOC


def test_namespaces_round_trip(spark):
    text = '<p:a xmlns:p="urn:x"><p:b k="v">t</p:b></p:a>'
    nodes = shredded(spark, text)
    assert sinks.serialize(nodes).first()["xml"] == text
    assert XPath(nodes, {"q": "urn:x"}).select("//q:b").count() == 1


def test_canonical_sorts_attributes(spark):
    assert sinks.serialize(shredded(spark, '<a b="2" a="1"><!-- gone --></a>'), canonical=True).first()["xml"] == '<a a="1" b="2"></a>'


def test_not_wellformed(spark):
    docs = spark.createDataFrame([(0, "<a><b></a>"), (1, "<a/>"), (2, None), (3, "")], "doc_id long, xml string")
    facts = {r["doc_id"]: r for r in xml.document_facts(docs).collect()}
    assert [facts[i]["wellformed"] for i in range(4)] == [False, True, False, False]
    assert facts[0]["line"] == 1
    assert {r["doc_id"] for r in xml.shred(docs).collect()} == {1}
    assert {r["doc_id"] for r in xml.shred(docs, recover=True).collect()} == {0, 1, 3}


def test_external_entities_are_not_read():
    rows, facts = xml.parse_xml(0, '<!DOCTYPE a [<!ENTITY e SYSTEM "file:///etc/passwd">]><a>&e;</a>')
    assert not facts["wellformed"] and rows == []


def test_html_supplies_tags(spark):
    nodes = shredded(spark, "<title>T</title><p>one<p>two<br><ul><li>a<li>b</ul>", html=True)
    x = XPath(nodes)
    assert x.select("/html/head/title").count() == 1
    assert x.select("/html/body/p").count() == 2
    assert x.select("//ul/li").count() == 2


@pytest.mark.parametrize("path, n", [("//b", 2), ("//b[2]/c", 1), ("/a/b[c]", 1), ("/a/b[. = 'one']", 1), ("/a/@*", 2), ("//comment()", 1), ("/a/text()", 1), ("//c/ancestor::*", 2), ("/a/b[1]/following-sibling::node()", 4), ("//b[last()]", 1), ("//b[position() = 1 or c]", 2), ("/a/processing-instruction()", 1), ("//b[not(c)]", 1), ("/a[@x = 1]/b[1]", 1), ("/nothing", 0)])
def test_paths(spark, path, n):
    assert XPath(shredded(spark, DOC)).select(path).count() == n


def test_bad_path():
    with pytest.raises(SyntaxError):
        tokens("/a[#]")


@pytest.mark.parametrize("data, name", [(b"\xef\xbb\xbf<a/>", "utf-8-sig"), ("<a/>".encode("utf-16"), "utf-16-le"), (b'<?xml version="1.0" encoding="ISO-8859-1"?><a/>', "iso-8859-1"), (b"<a/>", "utf-8"), (b"\x4c\x6f\xa7\x94\x93", "cp037")])
def test_encoding(data, name):
    assert xml.detect_encoding(data) == name


def test_events(spark):
    got = [r["event"] for r in xml.events(shredded(spark, "<a k='v'><b/>t</a>")).orderBy("seq").collect()]
    assert got == ["startDocument", "startElement", "attribute", "startElement", "endElement", "characters", "endElement", "endDocument"]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.xml").write_text(f"<a><b n='{i}'/></a>")
    nodes = documents.shred_stream(documents.read_documents(spark, str(folder)))
    documents.write_nodes(nodes, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["value"] for r in out.where(F.col("local") == "n").collect()) == ["0", "1", "2"]
