"""Queries of typed values, number pictures, URIs, JSON as XML, and functions of nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeloom.functions import jsonxml, text, values
from nodeloom.operators import nodes as of_nodes
from nodeloom.plans.xpath import XPath
from nodeloom.queries import library
from nodeloom.queries.paths import attributes
from nodeloom.sources import fixtures, resolve, xml
from nodeloom.sources.fixtures import table

QUERIES: dict = {}
ORACLE: dict = {}
C, L = F.col, F.lit


def _over(name: str, source: str, key: str, columns: dict) -> None:
    """As in ``library``, collected here."""
    library._over(name, source, key, columns)
    QUERIES[name], ORACLE[name] = library.QUERIES.pop(name), library.ORACLE.pop(name)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _dur():
    return values.duration(F.concat(L("P"), C("p_size"), L("MT"), C("p_partkey"), L("M"), C("p_size"), L(".5S")))


_S = "(p_partkey * 60 + p_size)"
_over("fn_durations", "part", "p_partkey", {
    "y": (lambda: values.years_from_duration(_dur()).cast("long"), "(p_size // 12)::BIGINT"),
    "m": (lambda: values.months_from_duration(_dur()).cast("long"), "(p_size % 12)::BIGINT"),
    "d": (lambda: values.days_from_duration(_dur()), f"{_S} // 86400"),
    "h": (lambda: values.hours_from_duration(_dur()), f"{_S} % 86400 // 3600"),
    "minute": (lambda: values.minutes_from_duration(_dur()), f"{_S} % 3600 // 60"),
    "s": (lambda: values.seconds_from_duration(_dur()).cast("double"), f"{_S} % 60 + 0.5::DOUBLE"),
    "negative": (lambda: values.months_from_duration(values.duration(F.concat(L("-P"), C("p_size"), L("M")))).cast("long"), "-(p_size % 12)::BIGINT"),
    "none": (lambda: values.duration(F.concat(L("P"), C("p_size"), L("H"))).isNull(), "true"),
    "shown": (lambda: values.duration_text(values.duration(F.concat(L("PT"), C("p_size") + 50, L(".250S")))), "'PT' || CASE WHEN p_size + 50 >= 60 THEN '1M' ELSE '' END || ((p_size + 50) % 60) || '.25S'"),
    "zero": (lambda: values.duration_text(values.duration(L("P0D"))), "'PT0S'"),
    "later": (lambda: F.date_format(values.add_duration(F.to_timestamp_ntz(L("2024-01-31 00:00:00")), values.duration(F.concat(L("P"), C("p_size"), L("MT1H")))), "yyyy-MM-dd HH"), "strftime(TIMESTAMP '2024-01-31' + INTERVAL (p_size) MONTH + INTERVAL 1 HOUR, '%Y-%m-%d %H')"),
    "twice": (lambda: values.days_from_duration(values.scale_duration(values.duration(F.concat(L("P"), C("p_size"), L("D"))), L(2))), "(p_size * 2)::BIGINT"),
})


def _stamp(zone: str):
    return values.zoned(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), L(zone)))


_over("fn_timezones", "orders", "o_orderkey", {
    "utc": (lambda: F.date_format(values.instant(_stamp("+02:30")), "yyyy-MM-dd HH:mm"), "strftime(o_orderdate - INTERVAL 150 MINUTE, '%Y-%m-%d %H:%M')"),
    "moved": (lambda: values.zoned_text(values.adjust_to_timezone(_stamp("Z"), -300)), "strftime(o_orderdate - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') || '-05:00'"),
    "received": (lambda: values.zoned_text(values.adjust_to_timezone(_stamp(""), 60)), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+01:00'"),
    "stripped": (lambda: values.zoned_text(values.adjust_to_timezone(_stamp("-07:00"), None)), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"),
    "zone": (lambda: values.timezone_from(_stamp("-05:30")), "'-PT5H30M'"),
    "joined": (lambda: values.zoned_text(values.date_time(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), L("Z")), L("12:34:56"))), "strftime(o_orderdate, '%Y-%m-%dT12:34:56Z')"),
    "mail": (lambda: values.zoned_text(text.parse_ietf_date(F.concat(L("Wed, "), F.date_format("o_orderdate", "dd MMM yyyy"), L(" 07:29:35 EST")))), "strftime(o_orderdate, '%Y-%m-%dT07:29:35-05:00')"),
    "asctime": (lambda: values.zoned_text(text.parse_ietf_date(F.concat(F.date_format("o_orderdate", "MMM d"), L(" 07:29 "), F.date_format("o_orderdate", "yyyy")))), "strftime(o_orderdate, '%Y-%m-%dT07:29:00Z')"),
    "no_mail": (lambda: text.parse_ietf_date(C("o_orderpriority")).isNull(), "true"),
})

_signed = lambda: (C("p_size") - 20).cast("string")
_over("xs_constructors", "part", "p_partkey", {
    "byte": (lambda: values.castable_as((C("p_size") * 5).cast("string"), "byte"), "p_size * 5 <= 127"),
    "unsigned": (lambda: values.castable_as(_signed(), "unsignedInt"), "p_size >= 20"),
    "positive": (lambda: values.castable_as(_signed(), "positiveInteger"), "p_size > 20"),
    "negative": (lambda: values.castable_as(_signed(), "negativeInteger"), "p_size < 20"),
    "integer": (lambda: values.construct(F.concat(L(" "), _signed(), L("\n")), "integer").cast("long"), "(p_size - 20)::BIGINT"),
    "decimal": (lambda: values.cast_as(F.concat(C("p_size"), L(".50")), "decimal").cast("double"), "p_size + 0.5::DOUBLE"),
    "no_decimal": (lambda: values.castable_as(F.concat(C("p_size"), L("e0")), "decimal"), "false"),
    "double": (lambda: values.cast_as(F.concat(C("p_size"), L("e1")), "double"), "p_size * 10::DOUBLE"),
    "infinite": (lambda: values.cast_as(L("-INF"), "double"), "'-inf'::DOUBLE"),
    "truth": (lambda: values.cast_as((C("p_size") % 3).cast("string"), "boolean"), "CASE p_size % 3 WHEN 0 THEN false WHEN 1 THEN true END"),
    "date": (lambda: values.castable_as(F.concat(L("2023-02-"), F.lpad(C("p_size").cast("string"), 2, "0"), L("Z")), "date"), "p_size BETWEEN 1 AND 28"),
    "date_time": (lambda: values.castable_as(F.concat(L("2023-02-"), F.lpad(C("p_size").cast("string"), 2, "0"), L("T24:00:00")), "dateTime"), "p_size BETWEEN 1 AND 28"),
    "month": (lambda: values.castable_as(F.concat(L("--"), F.lpad(C("p_size").cast("string"), 2, "0")), "gMonth"), "p_size BETWEEN 1 AND 12"),
    "hex": (lambda: F.hex(values.cast_as(F.lower(F.hex(C("p_name"))), "hexBinary")), "hex(p_name)"),
    "base": (lambda: F.decode(values.cast_as(F.base64(F.encode("p_name", "UTF-8")), "base64Binary"), "UTF-8"), "p_name"),
    "name": (lambda: values.castable_as(F.concat(C("p_size"), L("x")), "NCName"), "false"),
    "lang": (lambda: values.castable_as(L("de-CH"), "language"), "true"),
    "span": (lambda: values.castable_as(L("P1Y2M"), "dayTimeDuration"), "false"),
})

_over("fn_uris", "customer", "c_custkey", {
    "iri": (lambda: text.iri_to_uri(F.concat(L("http://x.y/é|"), C("c_name"))), "'http://x.y/%C3%A9%7C' || c_name"),
    "html": (lambda: text.escape_html_uri(F.concat(L("javascript: '😀'"), C("c_name"))), "'javascript: ''%F0%9F%98%80''' || c_name"),
    "resolved": (lambda: text.resolve_uri(F.concat(L("../d/"), C("c_custkey")), L("http://h/a/b/c?q")), "'http://h/a/d/' || c_custkey"),
    "composed": (lambda: F.length(text.normalize_unicode(F.concat(C("c_name"), L("é")))).cast("long"), "length(c_name) + 1"),
    "apart": (lambda: F.length(text.normalize_unicode(F.concat(C("c_name"), L("é")), "NFD")).cast("long"), "length(c_name) + 2"),
})

_WORDS = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen','twenty','twenty-one','twenty-two','twenty-three','twenty-four']"
_over("fn_number_pictures", "customer", "c_custkey", {
    "words": (lambda: text.number_words(C("c_nationkey")), f"{_WORDS}[c_nationkey + 1]"),
    "hundreds": (lambda: text.number_words(C("c_nationkey") + 1200), f"'one thousand two hundred' || CASE WHEN c_nationkey > 0 THEN ' and ' || {_WORDS}[c_nationkey + 1] ELSE '' END"),
    "twentieth": (lambda: text.number_words(L(20), ordinal=True), "'twentieth'"),
    "ordinal": (lambda: text.ordinal_number(C("c_nationkey")), "c_nationkey || CASE WHEN c_nationkey BETWEEN 11 AND 13 THEN 'th' WHEN c_nationkey % 10 = 1 THEN 'st' WHEN c_nationkey % 10 = 2 THEN 'nd' WHEN c_nationkey % 10 = 3 THEN 'rd' ELSE 'th' END"),
    "grouped": (lambda: text.format_number(C("c_custkey") * 1000, "#,##0.00"), "format('{:,}', c_custkey * 1000) || '.00'"),
    "percent": (lambda: text.format_number(C("c_nationkey") / 4, "0.#%"), "(c_nationkey * 25) || '%'"),
    "padded": (lambda: text.format_number(C("c_nationkey"), "000"), "lpad(c_nationkey::VARCHAR, 3, '0')"),
    "below": (lambda: text.format_number(-C("c_custkey") - 1, "0;(0)"), "'(' || (c_custkey + 1) || ')'"),
    "optional": (lambda: text.format_number(C("c_nationkey") + L(0.5), "#.0##"), "CASE WHEN c_nationkey > 0 THEN c_nationkey::VARCHAR ELSE '' END || '.5'"),
    "log0": (lambda: text.math_log(C("c_nationkey") * 0), "'-inf'::DOUBLE"),
    "log_below": (lambda: F.isnan(text.math_log(-C("c_custkey") - 1, base10=True)), "true"),
    "tens": (lambda: F.round(text.exp10(C("c_nationkey") / 10), 6), "round(pow(10.0, c_nationkey / 10.0), 6)"),
    "drawn": (lambda: text.random_number(C("c_custkey")).between(0, 1), "true"),
    "shuffled": (lambda: F.array_join(F.array_sort(text.permute(F.array(L(3), L(1), L(2)), C("c_custkey"))).cast("array<string>"), ","), "'1,2,3'"),
})


def _props():
    return F.concat(L('{"a":['), C("props"), L(',null,true,"x/y"],"k":"'), C("event_type"), L('"}'))


_over("fn_json_xml", "events", "event_id", {
    "back": (lambda: jsonxml.xml_to_json(jsonxml.json_to_xml(C("props"))), "replace(replace(props, ': ', ':'), ', ', ',')"),
    "root": (lambda: F.xpath_string(jsonxml.json_to_xml(_props()), L("name(/*)")), "'map'"),
    "typed": (lambda: F.xpath_string(jsonxml.json_to_xml(_props()), L("string(/*/*[@key='k'])")), "event_type"),
    "deep": (lambda: F.size(jsonxml.map_find(_props(), "k")), "2"),
    "none": (lambda: jsonxml.json_to_xml(C("event_type")).isNull(), "true"),
})

_LINES = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"SELECT l_orderkey AS doc_id, '/Q{{}}order[1]/Q{{}}line[' || p || ']/@qty' AS path FROM {_LINES}")
def fn_path(spark, sf_dir):
    nodes = fixtures.nodes(spark, sf_dir, "order_xml")
    return of_nodes.paths(XPath(nodes).select("//line/@qty"), nodes).select("doc_id", "path")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey IN (3, 7, 11)")
def fn_id(spark, sf_dir):
    nodes = fixtures.nodes(spark, sf_dir, "geo_xml").where((C("kind") != xml.ATTR) | C("parent").isNotNull())
    nation = attributes(nodes, "nation", ["id", "name"])
    only = nodes.join(nation.select("doc_id", C("pre").alias("parent")), ["doc_id", "parent"], "left_semi")
    refs = spark.range(1).select(L(0).cast("long").alias("doc_id"), L("11 3\n7 999").alias("value"))
    found = of_nodes.by_id(refs, of_nodes.ids(only, ["id"]))
    return nation.join(found, ["doc_id", "pre"], "left_semi").select(C("id").cast("long").alias("id"), "name")


_TAGGED = "<d xmlns:p='urn:p' xml:lang='{0}'><a n='1' m='2'><p:b/></a><a m='2' n='1' xml:lang='de-CH'><!--c--><p:b/></a><a n='1'><p:b/></a></d>"


def _tagged(spark, sf_dir):
    return xml.shred(table(spark, sf_dir, "nation").select(C("n_nationkey").alias("doc_id"), F.replace(L(_TAGGED), L("{0}"), F.when(C("n_nationkey") % 2 == 0, "en").otherwise("fr")).alias("xml")))


@query("SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS english, 1::BIGINT AS german FROM nation")
def fn_lang(spark, sf_dir):
    nodes = _tagged(spark, sf_dir)
    found = of_nodes.languages(XPath(nodes).select("/d/a"), nodes)
    count = lambda w: F.count(F.when(of_nodes.is_lang(C("lang"), w), 1))
    return found.groupBy("doc_id").agg(count("en").alias("english"), count("DE").alias("german"))


@query("SELECT n_nationkey::BIGINT AS doc_id, 2::BIGINT AS n_namespaces, 'xml' AS first FROM nation")
def axis_namespace(spark, sf_dir):
    nodes = _tagged(spark, sf_dir)
    found = of_nodes.namespaces(XPath(nodes, {"p": "urn:p"}).select("/d/a[1]/p:b"), nodes)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_namespaces"), F.max("prefix").alias("first"))


@query("SELECT n_nationkey::BIGINT AS doc_id, true AS kept, false AS other FROM nation")
def fn_deep_equal_nodes(spark, sf_dir):
    """An element is equal to itself under any order of attributes, and differs where an attribute is missing."""
    nodes = _tagged(spark, sf_dir).where("coalesce(local, '') <> 'lang'")
    d = of_nodes.digests(XPath(nodes).select("/d/a"), nodes).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pre", "digest"))).alias("d"))
    return d.select("doc_id", (C("d")[0]["digest"] == C("d")[1]["digest"]).alias("kept"), (C("d")[0]["digest"] == C("d")[2]["digest"]).alias("other"))


@query("SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'urn:five' WHEN c_nationkey = 3 THEN 'file:/three/' || c_custkey || '.xml' WHEN c_nationkey % 10 = 4 THEN 'file:/any/' || c_nationkey || '/' || c_custkey || '.xml' WHEN c_custkey % 10 = 7 THEN 'urn:seven' ELSE 'http://x/' || c_nationkey || '/' || c_custkey || '.xml' END AS resolved FROM (SELECT c_custkey, c_nationkey FROM customer)")
def catalog_resolution(spark, sf_dir):
    entries = [("uri", "http://x/9/5.xml", "urn:five"), ("rewrite", "http://x/3/", "file:/three/"), ("rewrite", "http://x/4/", "file:/any/4/"), ("rewrite", "http://x/14/", "file:/any/14/"), ("rewrite", "http://x/24/", "file:/any/24/"), ("suffix", "7.xml", "urn:seven")]
    entries = spark.createDataFrame(entries, "kind string, name string, target string")
    nation = F.when(C("c_custkey") == 5, 9).otherwise(C("c_nationkey"))
    uris = table(spark, sf_dir, "customer").select("c_custkey", F.concat(L("http://x/"), nation, L("/"), C("c_custkey"), L(".xml")).alias("uri"))
    return resolve.catalog(uris, entries).select("c_custkey", "resolved")


@query("SELECT n_nationkey::BIGINT AS doc_id, (4 + 2 * (n_nationkey % 3))::BIGINT AS size, (2 + n_nationkey % 3)::BIGINT AS items, n_nationkey::VARCHAR AS last FROM nation")
def xinclude(spark, sf_dir):
    """Each nation's document includes part 900 + k, which has k + 1 items; one item stands before it and one after it."""
    nations = table(spark, sf_dir, "nation")
    hosts = nations.select(C("n_nationkey").cast("long").alias("doc_id"), F.concat(L(f"<d xmlns:xi='{resolve.XI}'><i/><xi:include href='p"), C("n_nationkey") % 3, L("'><xi:fallback>no</xi:fallback></xi:include><i>"), C("n_nationkey"), L("</i></d>")).alias("xml"))
    parts = spark.range(900, 903).select(C("id").alias("doc_id"), F.concat(L("<g>"), F.repeat(L("<i>x</i>"), (C("id") - 900).cast("int")), L("</g>")).alias("xml"))
    nodes = xml.shred(hosts.unionByName(parts))
    hrefs = spark.range(3).select(F.concat(L("p"), C("id")).alias("href"), (C("id") + 900).alias("doc_id"))
    out = resolve.include(nodes, hrefs).where("doc_id < 900")
    x = XPath(out)
    size = out.where(C("kind") == xml.DOC).select("doc_id", (C("size") - 1).alias("size"))
    items = x.select("//i").groupBy("doc_id").agg(F.count("*").alias("items"))
    last = x.values("/d/i[last()]").select("doc_id", C("text").alias("last"))
    return size.join(items, "doc_id").join(last, "doc_id")


_T = "lineitem JOIN orders ON l_orderkey = o_orderkey"
PATHS = [
    ("predicate_path_compare", "//line[@part = @supp]", f"SELECT l_orderkey AS doc_id, count(*) AS n FROM {_T} WHERE l_partkey = l_suppkey GROUP BY 1"),
    ("predicate_path_less", "//line[@no < @disc * 100]", f"SELECT l_orderkey AS doc_id, count(*) AS n FROM {_T} WHERE l_linenumber < l_discount * 100 GROUP BY 1"),
    ("predicate_sum", "/order[sum(line/@qty) > 100]", "SELECT l_orderkey AS doc_id, 1::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING sum(l_quantity) > 100"),
    ("predicate_arithmetic", "//line[@qty * 2 - 1 > 60 and @no mod 2 = 1]", f"SELECT l_orderkey AS doc_id, count(*) AS n FROM {_T} WHERE l_quantity * 2 - 1 > 60 AND l_linenumber % 2 = 1 GROUP BY 1"),
    ("predicate_string_length", "/order[string-length(@priority) = 5]", "SELECT o_orderkey AS doc_id, 1::BIGINT AS n FROM orders WHERE length(o_orderpriority) = 5"),
    ("predicate_ends_with", "/order[ends-with(@priority, 'H')]", "SELECT o_orderkey AS doc_id, 1::BIGINT AS n FROM orders WHERE suffix(o_orderpriority, 'H')"),
    ("predicate_matches", "/order[matches(@priority, '^[1-3]-')]", "SELECT o_orderkey AS doc_id, 1::BIGINT AS n FROM orders WHERE regexp_matches(o_orderpriority, '^[1-3]-')"),
]


def _path_query(path: str):
    return lambda spark, sf_dir: XPath(fixtures.nodes(spark, sf_dir, "order_xml")).select(path).groupBy("doc_id").agg(F.count("*").alias("n"))


for _name, _path, _sql in PATHS:
    QUERIES[_name], ORACLE[_name] = _path_query(_path), _sql
