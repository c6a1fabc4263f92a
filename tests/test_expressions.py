"""Expressions over one small document."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import schema, schematron, templates
from nodeloom.plans.xpath import Seq, XPath
from nodeloom.plans.xslt import Stylesheet
from nodeloom.sources import sinks, xml

DOC = '<o id="7" d="2024-02-29"><l n="1" q="5" p="2.5">ab</l><l n="2" q="x">cd<b/></l><l n="3" q="7" p="1.5"/><!--c--></o>'

CASES = [
    ('1 + 2', 3), ('@id', '7'), ('@id + 1', 8.0), ('count(l)', 3), ('sum((1,2,3))', 6), ('l/@q', ['5', 'x', '7']), ('string(l[1])', 'ab'), ('l[last()]/@n', ['3']),
    ('l[last() - 1]/@n', ['2']), ('l[not(position() = 1)]/@n', ['2', '3']), ('for $i in 1 to 3 return $i * $i', [1, 4, 9]),
    ("for $l in l return concat($l/@n, '-', $l/@q)", ['1-5', '2-x', '3-7']), ("some $l in l satisfies $l/@q = 'x'", True), ('every $l in l satisfies $l/@q > 1', False),
    ('let $x := 5, $y := $x + 1 return $y * 2', 12), ("if (count(l) > 2) then 'many' else 'few'", 'many'), ('(1,2,3)[. > 1]', [2, 3]), ('(l)[2]/@n', ['2']),
    ('l ! @n', ['1', '2', '3']), ('(1 to 3) ! (. + 1)', [2, 3, 4]), ('l/string()', ['ab', 'cd', '']), ('l/name()', ['l', 'l', 'l']), ("map{'a':1,'b':2}?b", 2),
    ('[4,5,6](2)', 5), ('[4,5,6]?*', [4, 5, 6]), ('(1,2,3) => sum()', 6), ("'a' => upper-case() => concat('!')", 'A!'),
    ('for-each(1 to 3, function($a){ $a * 10 })', [10, 20, 30]), ('filter(1 to 5, function($a){ $a mod 2 = 0 })', [2, 4]),
    ('fold-left(1 to 4, 0, function($a,$b){ $a + $b })', 10), ("fold-right(('a','b'), '', function($a,$b){ concat($a,$b) })", 'ab'), ('5 div 2', 2.5), ('5 idiv 2', 2),
    ('-7 idiv 2', -3), ('-7 mod 3', -1), ('1 div 0e0', float("inf")), ("'5' cast as xs:integer", 5), ("'x' castable as xs:integer", False),
    ("xs:date('2024-01-05') + xs:dayTimeDuration('P2D')", datetime.date(2024, 1, 7)), ('1 instance of xs:integer', True), ('(1,2) instance of xs:integer+', True),
    ('l instance of element(l)+', True), ("'a' instance of xs:integer", False), ("string-join(l/@n, ',')", '1,2,3'), ('distinct-values((1,2,1))', [1, 2]),
    ('max((1,5,3))', 5), ('min(l/@n)', 1.0), ('avg((1,2))', 1.5), ("substring('hello', 2, 3)", 'ell'), ("substring('hello', number('x'))", ''),
    ("replace('abc','[ac]','-')", '-b-'), ("tokenize('a b c')", ['a', 'b', 'c']), ("matches('abc','B','i')", True), ("format-integer(1234, '#,##0')", '1,234'),
    ("format-integer(703,'a')", 'aaa'), ("format-date(@d, '[D1o] [MNn] [Y0001], [FNn]')", '29th February 2024, Thursday'),
    ("format-dateTime('2024-02-29T13:05:09.5Z','[h]:[m01] [PN] [Z]')", '1:05 PM +00:00'), ('year-from-date(@d)', 2024), ("hours-from-time('10:20:30')", 10),
    ("adjust-time-to-timezone('10:20:30Z','PT2H')", '12:20:30+02:00'), ("@d < '2025'", True), ('l[@q = 5]/@n', ['1']), ('l[@q != 5]/@n', ['2', '3']),
    ("l[@p < 'x']", ['ab', '']), ('l[contains(@q, @n)]', []), ('l[b]/@n', ['2']), ('l[not(b)]/@n', ['1', '3']), ('l[@n = ../l[2]/@n]/@n', ['2']),
    ('(l/@n = (2,9))', True), ('l[@n > 1 and @q]/@n', ['2', '3']), ('l[2] << l[3]', True), ('count(l union l[1])', 3), ('count(l intersect l[1])', 1),
    ('count(l except l[1])', 2), ('array:insert-before([1,2],1,9)', [9, 1, 2]), ('array:remove([1,2,3],2)', [1, 3]), ("map:keys(map{'x':1})", ['x']),
    ('array:size([1,(2,3)])', 2), ('sort((3,1,2))', [1, 2, 3]), ('reverse(1 to 3)', [3, 2, 1]), ('sort(l/@q, (), function($a){ string($a) })', ['5', '7', 'x']),
    ('exists(l/b)', True), ('empty(l/z)', True), ('not(l/z)', True), ('boolean(l)', True), ('has-children()', True), ('path(l[2]/b)', '/Q{}o[1]/Q{}l[2]/Q{}b[1]'),
    ('root()/o/@id', ['7']), ('local-name()', 'o'), ("concat('x', ?, 'z')('y')", 'xyz'), ("upper-case#1('a')", 'A'),
    ('for $l in l, $i in 1 to 2 return $l/@n * $i', [1.0, 2.0, 2.0, 4.0, 3.0, 6.0]), ('for $i in (1,3) return l[@n = $i]/@q', ['5', '7']),
    ('for $l in l return count($l/b)', [0, 1, 0]), ('for $l in l[@p] return $l/@q * $l/@p', [12.5, 10.5]), ('sum(l/@p)', 4.0),
    ('let $x := l[2] return $x/b/name()', ['b']), ('l/text()', ['ab', 'cd']), ('comment()', ['c']), ('//l[1]/@n', ['1']), ('//b/../@n', ['2']),
    ('/o/l[2]/preceding-sibling::l/@n', ['1']), ('1 = 1', True), ("'a' || 'b'", 'ab'), ('1 to 0', []), ('()', []), ("(1, 'a')", ['1', 'a']),
    ('l[position() = (1,3)]/@n', ['1', '3']), ('innermost(//*) ! name()', ['l', 'b', 'l']), ('fold-left(1 to 3, (), function($a,$b){ ($b, $a) })', [3, 2, 1]),
    ('apply(function($a,$b){ $a + $b }, [1,2])', 3), ('round(2.5)', 3.0), ('round(-2.5)', -2.0), ('round(2.345, 2)', 2.35), ('round-half-to-even(2.5)', 2.0),
    ('floor(2.7)', 2.0), ('ceiling(2)', 2), ('abs(-3)', 3), ("xs:integer('12') + xs:double('0.5')", 12.5), ("number('x')", float("nan")), ('string(1.0)', '1'),
    ('string(1.5e0)', '1.5'), ('string(true())', 'true'), ('1 eq 1', True), ("'a' lt 'b'", True), ('deep-equal((1,2),(1,2))', True), ('index-of((4,5,4),4)', [1, 3]),
    ('subsequence((1,2,3),2)', [2, 3]), ('head((1,2))', 1), ('tail((1,2))', [2]), ('(1,2)[2]', 2), ('remove((1,2,3),2)', [1, 3]),
    ('insert-before((1,2),2,9)', [1, 9, 2]), ("map:merge((map{'a':1},map{'a':2,'b':3}))?a", 1), ("map:for-each(map{'a':1}, function($k,$v){ concat($k,$v) })", ['a1']),
    ('parse-json(\'{"a": 1}\')', '{"a":1}'), ('codepoints-to-string((72,105))', 'Hi'), ("id('7')/@d", ['2024-02-29']), ("starts-with(@d, '2024')", True),
    ("l[starts-with(., 'a')]/@n", ['1']), ('l[string-length(.) = 2]/@n', ['1', '2']), ("matches('e','[a-z-[aeiou]]')", False), ('zero-or-one(())', None),
    ('node-name(l[1])', 'l'), ('generate-id() = generate-id(.)', True), ('l[1] is l[1]', True), ('function-arity(concat#3)', 3), ('true()', True),
    ("l/@q[. = 'x']", ['x']), ('l/(@n | @q)', ['1', '5', '2', 'x', '3', '7']), ("tokenize('a,b', ',')", ['a', 'b']),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return xml.shred(spark.createDataFrame([(1, DOC)], "doc_id long, xml string")).cache()


@pytest.mark.parametrize("part", range(0, len(CASES), 16))
def test_expressions(nodes, part):
    x = XPath(nodes)
    cases = CASES[part : part + 16]
    got = x.evaluate({f"r{i}": e for i, (e, _) in enumerate(cases)}, x.select("/o")).first()
    for i, (e, want) in enumerate(cases):
        have = got[f"r{i}"]
        assert have == want or isinstance(want, float) and math.isnan(want) and math.isnan(have), e


@pytest.mark.parametrize("text, kind", [("1 +", SyntaxError), ("$none", NameError), ("nothing(1)", NameError), ("/o[", SyntaxError), ("matches(@id, @d)", SyntaxError)])
def test_errors_in_expressions(nodes, text, kind):
    with pytest.raises(kind):
        XPath(nodes).evaluate({"r": text}, XPath(nodes).select("/o"))


@pytest.mark.parametrize("text", ["replace('abc', 'x*', '-')", "array:put([1], 2, 0)", "exactly-one((1, 2))", "one-or-more(())", "5 idiv 0", "error('X', 'y')", "parse-json('{')", "xs:integer('a')", "array:subarray([1, 2], 2, 5)", "'a' treat as xs:integer"])
def test_errors_in_data(nodes, text):
    with pytest.raises(Exception, match="FORX0003|FOAY0001|FORG0005|FORG0004|FOAR0001|X: y|MALFORMED|FORG0001|XPDY0050"):
        XPath(nodes).evaluate({"r": text}, XPath(nodes).select("/o")).collect()


def test_nodes_found_from_many_contexts(spark):
    """The string value of a node that several contexts reach is not repeated."""
    n = xml.shred(spark.createDataFrame([(1, "<r><k>v</k><b/><b/></r>")], "doc_id long, xml string"))
    assert XPath(n).select("//b[../k = 'v']").count() == 2


def test_functions_of_the_user_and_variables(nodes):
    twice = lambda s: Seq(s.one() * 2, "integer")
    x = XPath(nodes, functions={"my:twice": twice})
    got = x.evaluate({"a": "my:twice($n) + 1", "b": "sum(for $i in 1 to 3 return my:twice($i))", "c": "@id = $s"}, x.select("/o"), {"n": 4, "s": "7"}).first()
    assert (got["a"], got["b"], got["c"]) == (9, 12, True)


def test_attribute_maps_follow_edits(nodes):
    x = XPath(nodes)
    line = x.select("//l[1]").withColumn("new_value", F.lit("9"))
    changed = templates.set_attribute(nodes, line, "q")
    assert XPath(changed).select("//l[@q = 9]/@q").count() == 1
    cut = templates.unlink(nodes, x.select("//l/@q"))
    assert XPath(cut).select("//l[@q]").count() == 0 and XPath(cut).select("//l[@n]").count() == 3


@pytest.mark.parametrize("text", ['<a xmlns:p="urn:x" p:k="v"/>', '<p:a xmlns:p="u"><q:b xmlns:q="u"/></p:a>', '<a xmlns:z="urn:z" xmlns="d"><b xmlns=""/></a>'])
def test_declarations_come_back(spark, text):
    n = xml.shred(spark.createDataFrame([(1, text)], "doc_id long, xml string"))
    assert sinks.serialize(n).first()["xml"] == text


def test_canonical_form(spark):
    text = '<?b x?><a xmlns:z="urn:z" xmlns:p="u" b="1" a="2"><p:c xmlns:p="u"/><!--no--></a><?e?>'
    n = xml.shred(spark.createDataFrame([(1, text)], "doc_id long, xml string"))
    assert sinks.serialize(n, canonical=True).first()["xml"] == '<?b x?>\n<a xmlns:p="u" xmlns:z="urn:z" a="2" b="1"><p:c></p:c></a>\n<?e?>'


HEAD = '<xsl:stylesheet version="3.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform">'


@pytest.mark.parametrize(
    "body, want",
    [
        ('<xsl:template match="l"><x><xsl:value-of select="."/></x></xsl:template>', "<x>ab</x><x>cd</x><x></x>"),
        ('<xsl:template match="l[@q = 5]" priority="2">[<xsl:next-match/>]</xsl:template><xsl:template match="l"><xsl:value-of select="@n"/></xsl:template>', "[1]23"),
        ('<xsl:mode on-no-match="shallow-copy"/><xsl:template match="l[@n != 1] | comment()"/>', '<o id="7" d="2024-02-29"><l n="1" q="5" p="2.5">ab</l></o>'),
        ('<xsl:template match="o"><xsl:for-each select="l"><xsl:value-of select="count(../l[@q = current()/@q])"/></xsl:for-each></xsl:template>', "111"),
        ('<xsl:template match="/"><xsl:where-populated><e><xsl:value-of select="//z"/></e></xsl:where-populated><xsl:perform-sort select="//l/@q"><xsl:sort select="." order="descending"/></xsl:perform-sort></xsl:template>', "x 7 5"),
    ],
)
def test_stylesheets(nodes, body, want):
    assert Stylesheet(f"{HEAD}{body}</xsl:stylesheet>").transform(nodes).first()["text"] == want


def test_stylesheet_that_calls_itself():
    text = f'{HEAD}<xsl:template match="/"><xsl:call-template name="t"/></xsl:template><xsl:template name="t"><xsl:call-template name="t"/></xsl:template></xsl:stylesheet>'
    with pytest.raises(RecursionError):
        Stylesheet(text).choice(None, 0)


def test_first_rule_of_a_pattern(nodes):
    text = '<schema xmlns="http://purl.oclc.org/dsdl/schematron"><pattern id="p"><rule context="l[@n = 1]"><assert test="@q > 6">q is <value-of select="@q"/> in <name/></assert></rule><rule context="l"><assert test="@q > 6">no</assert></rule></pattern></schema>'
    got = [(r["rule"], r["message"]) for r in schematron.validate(nodes, text).orderBy("pre").collect()]
    assert got == [("@q > 6", "q is 5 in l"), ("@q > 6", "no")]


def test_schema_with_all_list_union_and_keys(spark):
    text = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r"><xs:complexType><xs:all><xs:element name="a" type="sizes"/><xs:element name="b" type="mixed" minOccurs="0"/><xs:element name="k" minOccurs="0">
    <xs:complexType><xs:attribute name="id"/><xs:attribute name="to"/></xs:complexType></xs:element></xs:all></xs:complexType><xs:key name="ids"><xs:selector xpath="k"/><xs:field xpath="@id"/></xs:key><xs:keyref name="refs" refer="ids"><xs:selector xpath="k"/><xs:field xpath="@to"/></xs:keyref></xs:element>
    <xs:simpleType name="sizes"><xs:restriction><xs:simpleType><xs:list itemType="xs:int"/></xs:simpleType><xs:maxLength value="2"/></xs:restriction></xs:simpleType><xs:simpleType name="mixed"><xs:union memberTypes="xs:int xs:date"/></xs:simpleType></xs:schema>"""
    docs = ["<r><b>2024-01-01</b><a>1 2</a></r>", "<r><a>1 2 3</a></r>", "<r><a>1</a><a>2</a></r>", "<r><a>x</a><b>y</b></r>", '<r><a>1</a><k to="q"/></r>', "<z/>", '<r><a>1</a><k id="i" to="i"/></r>']
    nodes = xml.shred(spark.createDataFrame(list(enumerate(docs)), "doc_id long, xml string"))
    got = {}
    for r in schema.Schema(text).validate(nodes).collect():
        got.setdefault(r["doc_id"], set()).add(r["rule"])
    assert got == {1: {"type a"}, 2: {"content r"}, 3: {"type a", "type b"}, 4: {"key ids", "keyref refs"}, 5: {"root"}}
