"""Queries by documents of their own: XSLT stylesheets, Schematron and XML Schema schemas, over the order documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeloom.operators import schema, schematron
from nodeloom.plans.xslt import Stylesheet
from nodeloom.queries.expressions import _ORDERS
from nodeloom.sources import fixtures

QUERIES: dict = {}
ORACLE: dict = {}

_XSLT = '<xsl:stylesheet version="3.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" xmlns:my="urn:my">{}</xsl:stylesheet>'


def stylesheet(name: str, body: str, sql: str, parameters: dict | None = None, included: dict[str, str] | None = None) -> None:
    """sql: the text written for an order, over its row and its lists of lines."""

    def run(spark, sf_dir):
        return Stylesheet(_XSLT.format(body), included).transform(fixtures.nodes(spark, sf_dir, "order_xml"), parameters)

    QUERIES[name] = run
    ORACLE[name] = f"SELECT o_orderkey AS doc_id, {sql} AS text FROM {_ORDERS}"


def _lines(body: str, where: str = "true") -> str:
    """Text over the lines i of an order."""
    return f"coalesce(array_to_string(list_transform(list_filter(range(1, len(no) + 1), lambda i: {where}), lambda i: {body}), ''), '')"


stylesheet(
    "xslt_rules",
    """<xsl:template match="/"><xsl:apply-templates select="order"/></xsl:template>
    <xsl:template match="order"><o id="{@id}"><xsl:apply-templates select="line[@ret = 'R']"/><xsl:apply-templates select="line" mode="short"/></o></xsl:template>
    <xsl:template match="line"><l><xsl:value-of select="@no"/></l></xsl:template>
    <xsl:template match="line[@qty > 25]" priority="2"><big><xsl:next-match/></big></xsl:template>
    <xsl:template match="line" mode="short">.</xsl:template>""",
    "'<o id=\"' || o_orderkey || '\">' || " + _lines("CASE WHEN qty[i] > 25 THEN '<big><l>' || no[i] || '</l></big>' ELSE '<l>' || no[i] || '</l>' END", "ret[i] = 'R'") + " || repeat('.', len(no)::INTEGER) || '</o>'",
)
stylesheet(
    "xslt_instructions",
    """<xsl:param name="limit" select="1"/><xsl:variable name="mark" select="concat('#', $limit)"/>
    <xsl:function name="my:twice"><xsl:param name="x"/><xsl:sequence select="$x * 2"/></xsl:function>
    <xsl:template name="head"><xsl:param name="of"/><h><xsl:value-of select="$of"/></h></xsl:template>
    <xsl:template match="/order"><xsl:call-template name="head"><xsl:with-param name="of" select="count(line)"/></xsl:call-template>
    <xsl:for-each select="line"><xsl:sort select="@no" data-type="number" order="descending"/><i><xsl:value-of select="position()"/>:<xsl:value-of select="@no"/></i></xsl:for-each>
    <xsl:choose><xsl:when test="count(line) > $limit">many</xsl:when><xsl:otherwise>few</xsl:otherwise></xsl:choose>
    <xsl:if test="@status = 'O'">!</xsl:if><xsl:element name="e{$limit}"><xsl:attribute name="a" select="my:twice(4)"/><xsl:value-of select="$mark"/></xsl:element>
    <xsl:comment>c</xsl:comment><xsl:processing-instruction name="p">q</xsl:processing-instruction><xsl:number value="14" format="I"/><xsl:text> t</xsl:text></xsl:template>""",
    "'<h>' || len(no) || '</h>' || " + "coalesce(array_to_string(list_transform(range(1, len(no) + 1), lambda i: '<i>' || i || ':' || list_reverse(list_sort(no))[i] || '</i>'), ''), '')"
    + " || CASE WHEN len(no) > 3 THEN 'many' ELSE 'few' END || CASE WHEN o_orderstatus = 'O' THEN '!' ELSE '' END || '<e3 a=\"8\">#3</e3><!--c--><?p q?>XIV t'",
    {"limit": 3},
)
stylesheet(
    "xslt_groups_keys",
    """<xsl:import href="base"/><xsl:key name="by" match="line" use="@ret"/>
    <xsl:template match="order"><xsl:for-each-group select="line" group-by="@ret"><xsl:sort select="current-grouping-key()"/><g k="{current-grouping-key()}"><xsl:value-of select="count(current-group())"/></g></xsl:for-each-group>
    <k><xsl:value-of select="count(key('by', 'R'))"/></k><xsl:apply-imports/></xsl:template>""",
    "coalesce(array_to_string(list_transform(list_sort(list_distinct(ret)), lambda r: '<g k=\"' || r || '\">' || len(list_filter(ret, lambda s: s = r)) || '</g>'), ''), '') || '<k>' || len(list_filter(ret, lambda s: s = 'R')) || '</k><base>' || o_orderkey || '</base>'",
    included={"base": _XSLT.format('<xsl:template match="order"><base><xsl:value-of select="@id"/></base></xsl:template>')},
)
stylesheet(
    "xslt_identity",
    """<xsl:mode on-no-match="shallow-copy"/><xsl:template match="line[@ret != 'R']"/>
    <xsl:template match="line"><xsl:copy><xsl:attribute name="no" select="@no"/></xsl:copy></xsl:template>""",
    "'<order id=\"' || o_orderkey || '\" cust=\"' || o_custkey || '\" status=\"' || o_orderstatus || '\" total=\"' || o_totalprice || '\" date=\"' || strftime(o_orderdate, '%Y-%m-%d') || '\" priority=\"' || o_orderpriority || '\">' || "
    + _lines("'<line no=\"' || no[i] || '\"></line>'", "ret[i] = 'R'") + " || '</order>'",
)

_SCH = """<schema xmlns="http://purl.oclc.org/dsdl/schematron"><let name="most" value="45"/>
<pattern id="lines"><rule context="line[@ret = 'R']"><assert id="returned" test="@qty &lt;= $most"><name/> <value-of select="@no"/> has <value-of select="@ret"/></assert></rule>
<rule context="line"><let name="q" value="number(@qty)"/><report id="low" test="$q &lt; 3">low</report></rule></pattern>
<pattern id="orders"><rule context="order"><assert id="some" test="line">no line</assert><assert id="status" test="@status = ('F', 'O')">status</assert></rule></pattern></schema>"""


def schematron_document(spark, sf_dir):
    return schematron.validate(fixtures.nodes(spark, sf_dir, "order_xml"), _SCH).select("doc_id", "pattern", "kind", "rule", "message")


_L = "(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
QUERIES["schematron_document"] = schematron_document
ORACLE["schematron_document"] = f"""SELECT l_orderkey AS doc_id, 'lines' AS pattern, 'assert' AS kind, 'returned' AS rule, 'line ' || l_linenumber || ' has R' AS message FROM {_L} WHERE l_returnflag = 'R' AND l_quantity > 45
UNION ALL SELECT l_orderkey, 'lines', 'report', 'low', 'low' FROM {_L} WHERE l_returnflag <> 'R' AND l_quantity < 3
UNION ALL SELECT o_orderkey, 'orders', 'assert', 'some', 'no line' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT o_orderkey, 'orders', 'assert', 'status', 'status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"""

_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
<xs:simpleType name="flag"><xs:restriction base="xs:string"><xs:enumeration value="R"/><xs:enumeration value="N"/></xs:restriction></xs:simpleType>
<xs:simpleType name="rate"><xs:restriction base="xs:decimal"><xs:maxExclusive value="0.09"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType>
<xs:attributeGroup name="amounts"><xs:attribute name="qty" use="required"><xs:simpleType><xs:restriction base="xs:decimal"><xs:minInclusive value="2"/><xs:maxInclusive value="48"/></xs:restriction></xs:simpleType></xs:attribute>
<xs:attribute name="price" type="xs:decimal"/><xs:attribute name="disc" type="rate"/></xs:attributeGroup>
<xs:complexType name="lineType"><xs:attribute name="no" type="xs:positiveInteger" use="required"/><xs:attribute name="part" type="xs:int"/><xs:attributeGroup ref="amounts"/><xs:attribute name="ret" type="flag"/></xs:complexType>
<xs:element name="order"><xs:complexType><xs:sequence><xs:element name="line" type="lineType" maxOccurs="6"/></xs:sequence>
<xs:attribute name="id" type="xs:integer" use="required"/><xs:attribute name="cust" type="xs:integer"/><xs:attribute name="status"><xs:simpleType><xs:restriction base="xs:token"><xs:pattern value="[FO]"/></xs:restriction></xs:simpleType></xs:attribute>
<xs:attribute name="total" type="xs:double"/><xs:attribute name="date" type="xs:date"/><xs:attribute name="priority"><xs:simpleType><xs:restriction base="xs:string"><xs:maxLength value="8"/></xs:restriction></xs:simpleType></xs:attribute></xs:complexType>
<xs:unique name="parts"><xs:selector xpath="line"/><xs:field xpath="@part"/></xs:unique></xs:element></xs:schema>"""


def schema_document(spark, sf_dir):
    return schema.Schema(_XSD).validate(fixtures.nodes(spark, sf_dir, "order_xml")).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


QUERIES["schema_document"] = schema_document
ORACLE["schema_document"] = f"""WITH v AS (
SELECT l_orderkey AS doc_id, 'type line/@qty' AS rule FROM {_L} WHERE l_quantity NOT BETWEEN 2 AND 48
UNION ALL SELECT l_orderkey, 'type line/@disc' FROM {_L} WHERE l_discount >= 0.09
UNION ALL SELECT l_orderkey, 'type line/@ret' FROM {_L} WHERE l_returnflag NOT IN ('R', 'N')
UNION ALL SELECT l_orderkey, 'undeclared line' FROM {_L}
UNION ALL SELECT o_orderkey, 'content order' FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) NOT BETWEEN 1 AND 6
UNION ALL SELECT o_orderkey, 'type order/@status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'type order/@priority' FROM orders WHERE length(o_orderpriority) > 8
UNION ALL SELECT l_orderkey, 'unique parts' FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS c FROM {_L}) WHERE c > 1
) SELECT doc_id, rule, count(*) AS n FROM v GROUP BY ALL"""
