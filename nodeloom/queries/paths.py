"""Queries over node tables: axes, predicates, joins, sets, grouping, numbering, constraints, output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators import constraints, grouping
from nodeloom.plans import axes
from nodeloom.plans.xpath import XPath
from nodeloom.sources import fixtures, sinks, xml

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _orders(spark: SparkSession, sf_dir: str) -> XPath:
    return XPath(fixtures.nodes(spark, sf_dir, "order_xml"))


def _per_doc(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_id").agg(F.count("*").alias("n"))


_N = "(SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"

#: name, path, oracle of (doc_id, n)
PATHS = [
    ("axis_child", "/order/line", f"SELECT * FROM {_N}"),
    ("axis_attribute", "/order/line/@*", f"SELECT doc_id, 7 * n AS n FROM {_N}"),
    ("axis_descendant", "/descendant::line", f"SELECT * FROM {_N}"),
    ("axis_descendant_or_self", "/order/descendant-or-self::*", f"SELECT o_orderkey AS doc_id, coalesce(n, 0) + 1 AS n FROM orders LEFT JOIN {_N} ON doc_id = o_orderkey"),
    ("axis_self", "//*/self::line", f"SELECT * FROM {_N}"),
    ("axis_parent", "//line/..", f"SELECT doc_id, 1::BIGINT AS n FROM {_N}"),
    ("axis_ancestor", "//line/@qty/ancestor::*", f"SELECT doc_id, n + 1 AS n FROM {_N}"),
    ("axis_ancestor_or_self", "//line/ancestor-or-self::node()", f"SELECT doc_id, n + 2 AS n FROM {_N}"),
    ("axis_following_sibling", "//line[1]/following-sibling::line", f"SELECT doc_id, n - 1 AS n FROM {_N} WHERE n > 1"),
    ("axis_preceding_sibling", "//line[last()]/preceding-sibling::line", f"SELECT doc_id, n - 1 AS n FROM {_N} WHERE n > 1"),
    ("axis_following", "/order/line[2]/following::*", f"SELECT doc_id, n - 2 AS n FROM {_N} WHERE n > 2"),
    ("axis_preceding", "/order/line[3]/preceding::*", f"SELECT doc_id, 2::BIGINT AS n FROM {_N} WHERE n > 2"),
    ("path_absolute_root", "/", "SELECT o_orderkey AS doc_id, 1::BIGINT AS n FROM orders"),
    ("path_union", "//line[@ret = 'R'] | //line[@qty > 40]", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' OR l_quantity > 40 GROUP BY 1"),
    ("test_wildcard", "/*/*", f"SELECT * FROM {_N}"),
    ("test_kind_node", "/order/node()", f"SELECT * FROM {_N}"),
    ("predicate_position", "/order/line[2]", f"SELECT doc_id, 1::BIGINT AS n FROM {_N} WHERE n >= 2"),
    ("predicate_last", "/order/line[last()]", f"SELECT doc_id, 1::BIGINT AS n FROM {_N}"),
    ("predicate_position_range", "/order/line[position() <= 3]", f"SELECT doc_id, least(n, 3) AS n FROM {_N}"),
    ("predicate_attribute_exists", "/order[@priority]/line", f"SELECT * FROM {_N}"),
    ("predicate_attribute_equals", "//line[@ret = 'N']", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' GROUP BY 1"),
    ("predicate_compare", "//line[@disc >= 0.05]", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount >= 0.05 GROUP BY 1"),
    ("predicate_and", "//line[@qty < 10 and @ret != 'N']", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 10 AND l_returnflag <> 'N' GROUP BY 1"),
    ("predicate_or", "//line[@qty < 5 or @qty > 45]", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 5 OR l_quantity > 45 GROUP BY 1"),
    ("predicate_not_antijoin", "/order[not(line/@ret = 'R')]", "SELECT o_orderkey AS doc_id, 1::BIGINT AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    ("predicate_exists_semijoin", "/order[line/@qty > 48]", "SELECT o_orderkey AS doc_id, 1::BIGINT AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)"),
    ("predicate_count", "/order[count(line) > 5]/line", f"SELECT * FROM {_N} WHERE n > 5"),
    ("predicate_contains", "/order[contains(@priority, 'U')]", "SELECT o_orderkey AS doc_id, 1::BIGINT AS n FROM orders WHERE contains(o_orderpriority, 'U')"),
    ("predicate_starts_with", "/order[starts-with(@priority, '1')]", "SELECT o_orderkey AS doc_id, 1::BIGINT AS n FROM orders WHERE starts_with(o_orderpriority, '1')"),
]


def _path_query(path: str):
    return lambda spark, sf_dir: _per_doc(_orders(spark, sf_dir).select(path))


for _name, _path, _sql in PATHS:
    QUERIES[_name], ORACLE[_name] = _path_query(_path), _sql


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line elements of orders with their attributes as columns."""
    nodes = fixtures.nodes(spark, sf_dir, "order_xml")
    return attributes(nodes, "line", ["no", "part", "supp", "qty", "price", "disc", "ret"])


def attributes(nodes: DataFrame, local: str, names: list[str]) -> DataFrame:
    """(doc_id, pre, one column a name) of the elements called ``local``: attributes without a namespace, from the map that an element carries."""
    elements = nodes.where((F.col("kind") == xml.ELEM) & (F.col("local") == local))
    return elements.select("doc_id", "pre", "parent", "size", "level", *[F.try_element_at("attrs", F.lit(n)).alias(n) for n in names])


_L = "(SELECT lineitem.*, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"SELECT l_returnflag AS ret, count(*) AS n, sum(l_quantity) AS total, avg(l_quantity) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM {_L} GROUP BY 1")
def aggregate_six(spark, sf_dir):
    q = F.col("qty").cast("double")
    return _lines(spark, sf_dir).groupBy("ret").agg(F.count("*").alias("n"), F.sum(q).alias("total"), F.avg(q).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"))


@query(f"SELECT l_returnflag AS grouping_key, count(*) AS n, sum(l_quantity) AS qty FROM {_L} GROUP BY 1")
def group_by_key(spark, sf_dir):
    return grouping.group_by(_lines(spark, sf_dir), F.col("ret"), ["doc_id", "pre"], F.count("*").alias("n"), F.sum(F.col("qty").cast("double")).alias("qty")).drop("first_seen")


@query(f"SELECT l_returnflag AS ret, l_linenumber::VARCHAR AS no, count(*) AS n FROM {_L} GROUP BY ALL")
def group_by_composite(spark, sf_dir):
    groups = grouping.group_by(_lines(spark, sf_dir), F.struct("ret", "no"), ["doc_id", "pre"], F.count("*").alias("n"))
    return groups.select("grouping_key.ret", "grouping_key.no", "n")


@query("WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS k FROM documents) SELECT k AS grouping_key, count(*) AS n FROM w WHERE k <> '' GROUP BY 1")
def group_by_many_keys(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), "[^a-z]+").alias("keys"))
    return grouping.group_by(docs.withColumn("pre", F.lit(0)), F.col("keys"), ["doc_id"], F.count("*").alias("n"), multi=True).where("grouping_key <> ''").drop("first_seen")


@query("SELECT DISTINCT round(l_discount * 100)::BIGINT AS value FROM lineitem")
def distinct_values(spark, sf_dir):
    d = _lines(spark, sf_dir).select(F.round(grouping.canonical(F.col("disc"), numeric=True) * 100).cast("long").alias("value"))
    return d.distinct()


@query("SELECT min(event_id) AS event_id, user_id AS doc_id, event_type AS type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY ALL")
def group_muenchian_first(spark, sf_dir):
    from pyspark.sql import Window

    e = _events(spark, sf_dir)
    return e.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("pre"))).where("r = 1").select(F.col("id").cast("long").alias("event_id"), "doc_id", "type")


def _events(spark, sf_dir):
    return attributes(fixtures.nodes(spark, sf_dir, "event_xml"), "e", ["id", "type", "value"])


_E = "(SELECT user_id AS doc_id, event_type AS type, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"


@query(f"WITH c AS (SELECT *, CASE WHEN type IS DISTINCT FROM lag(type) OVER (PARTITION BY doc_id ORDER BY p) OR p = 1 THEN 1 ELSE 0 END AS o FROM {_E}), g AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY p) AS group_no FROM c) SELECT doc_id, group_no::BIGINT AS group_no, any_value(type) AS type, count(*) AS n FROM g GROUP BY 1, 2")
def group_adjacent(spark, sf_dir):
    g = grouping.group_adjacent(_events(spark, sf_dir), ["doc_id"], ["pre"], F.col("type"))
    return g.groupBy("doc_id", "group_no").agg(F.first("type").alias("type"), F.count("*").alias("n"))


_PURCHASE = "(SELECT min(event_type) FROM events)"


@query(f"WITH g AS (SELECT *, sum(CASE WHEN p = 1 OR value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS group_no FROM {_E}) SELECT doc_id, group_no::BIGINT AS group_no, count(*) AS n FROM g GROUP BY 1, 2")
def group_starting_with(spark, sf_dir):
    g = grouping.group_starting_with(_events(spark, sf_dir), ["doc_id"], ["pre"], F.col("value").cast("double") > 90)
    return g.groupBy("doc_id", "group_no").agg(F.count("*").alias("n"))


@query(f"WITH g AS (SELECT *, 1 + coalesce(sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS group_no FROM {_E}) SELECT doc_id, group_no::BIGINT AS group_no, count(*) AS n FROM g GROUP BY 1, 2")
def group_ending_with(spark, sf_dir):
    g = grouping.group_ending_with(_events(spark, sf_dir), ["doc_id"], ["pre"], F.col("value").cast("double") > 90)
    return g.groupBy("doc_id", "group_no").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_key_lookup(spark, sf_dir):
    """key('customer', @cust): documents joined with a table on the canonical key."""
    orders = attributes(fixtures.nodes(spark, sf_dir, "order_xml"), "order", ["cust", "total"])
    people = fixtures.table(spark, sf_dir, "customer").select(grouping.canonical(F.col("c_custkey"), True).alias("k"), "c_mktsegment")
    found = orders.withColumn("k", grouping.canonical(F.col("cust"), True)).join(people, "k")
    return found.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum(F.col("total").cast("double")).alias("total"))


@query(f"SELECT c.l_orderkey AS doc_id, count(*) AS n FROM {_L} AS c JOIN {_L} AS d ON c.l_orderkey = d.l_orderkey AND c.l_suppkey = d.l_suppkey AND c.l_partkey < d.l_partkey GROUP BY 1")
def join_nested_for(spark, sf_dir):
    """for $a in line, $b in line[@supp = $a/@supp] where $a/@part < $b/@part: decorrelated to an equi join."""
    a = _lines(spark, sf_dir).select("doc_id", "supp", F.col("part").cast("long").alias("a"))
    b = a.select("doc_id", "supp", F.col("a").alias("b"))
    return _per_doc(a.join(b, ["doc_id", "supp"]).where(F.col("a") < F.col("b")))


@query("WITH m AS (SELECT o_custkey AS k, count(*) AS orders, 0 AS accounts FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 0, 1 FROM customer) SELECT k AS cust, sum(orders)::BIGINT AS orders, sum(accounts)::BIGINT AS accounts FROM m GROUP BY 1")
def merge_sources(spark, sf_dir):
    orders = attributes(fixtures.nodes(spark, sf_dir, "order_xml"), "order", ["cust"]).select(F.col("cust").cast("long").alias("cust"))
    people = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"))
    of = lambda s: F.sum(F.when(F.col("source") == s, 1).otherwise(0)).cast("long").alias(s)
    return grouping.merge({"orders": orders, "accounts": people}, ["cust"], of("orders"), of("accounts"))


@query("WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier) SELECT n_nationkey::BIGINT AS a, s_suppkey AS b FROM n JOIN s USING (p)")
def join_for_each_pair(spark, sf_dir):
    from pyspark.sql import Window

    geo = fixtures.nodes(spark, sf_dir, "geo_xml")
    place = lambda c: F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col(c).cast("long")))
    a = attributes(geo, "nation", ["id"]).select("doc_id", F.col("id").cast("long").alias("a"), place("id").alias("p"))
    b = attributes(geo, "supplier", ["id"]).select("doc_id", F.col("id").cast("long").alias("b"), place("id").alias("p"))
    return a.join(b, ["doc_id", "p"]).select("a", "b")


@query("SELECT o_orderkey AS doc_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 20 GROUP BY 1")
def set_intersect(spark, sf_dir):
    x = _orders(spark, sf_dir)
    return _per_doc(x.select("//line[@ret = 'R']").join(x.select("//line[@qty > 20]"), ["doc_id", "pre"], "left_semi"))


@query("SELECT o_orderkey AS doc_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND NOT l_quantity > 20 GROUP BY 1")
def set_except(spark, sf_dir):
    x = _orders(spark, sf_dir)
    return _per_doc(x.select("//line[@ret = 'R']").join(x.select("//line[@qty > 20]"), ["doc_id", "pre"], "left_anti"))


@query("SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)) AS inner_n, (SELECT count(*) FROM region) AS outer_n")
def set_innermost_outermost(spark, sf_dir):
    x = XPath(fixtures.nodes(spark, sf_dir, "geo_xml"))
    all_ = x.select("//region | //nation | //supplier")
    a = axes.innermost(all_).where("local <> 'region'").agg(F.count("*").alias("inner_n"))
    b = axes.outermost(all_).agg(F.count("*").alias("outer_n"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


@query("SELECT n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS number FROM nation")
def number_single(spark, sf_dir):
    n = attributes(fixtures.nodes(spark, sf_dir, "geo_xml"), "nation", ["name"]).withColumn("local", F.lit("nation"))
    return grouping.number_single(n).select("name", F.col("number").cast("long").alias("number"))


@query("WITH r AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS a FROM region), n AS (SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) SELECT n_name AS name, a || '.' || b AS number FROM n JOIN r ON n_regionkey = r_regionkey")
def number_multiple(spark, sf_dir):
    nodes = fixtures.nodes(spark, sf_dir, "geo_xml")
    counted = nodes.where((F.col("kind") == xml.ELEM) & F.col("local").isin("region", "nation"))
    n = attributes(nodes, "nation", ["name"])
    return n.select("doc_id", "pre", "name").join(grouping.number_multiple(n, counted), ["doc_id", "pre"]).select("name", "number")


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY n_regionkey, n_nationkey, s_suppkey) AS number FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def number_any(spark, sf_dir):
    s = attributes(fixtures.nodes(spark, sf_dir, "geo_xml"), "supplier", ["id"])
    return grouping.number_any(s).select(F.col("id").cast("long").alias("id"), F.col("number").cast("long").alias("number"))


@query(f"SELECT event_id, sum(value) OVER (PARTITION BY doc_id ORDER BY p) - value < 500 AS early, p::BIGINT AS seen FROM {_E}")
def accumulator(spark, sf_dir):
    nodes = fixtures.nodes(spark, sf_dir, "event_xml")
    e = _events(spark, sf_dir)
    v = e.select("doc_id", "pre", F.col("value").cast("double").alias("v"))
    rows = nodes.where(F.col("kind") == xml.ELEM).join(v, ["doc_id", "pre"], "left")
    total = grouping.accumulate(rows, F.col("v"), at_end=True).select("doc_id", "pre", F.col("before").alias("sum_before"))
    seen = grouping.accumulate(rows, F.when(F.col("local") == "e", 1)).select("doc_id", "pre", F.col("before").alias("seen"))
    out = e.join(total, ["doc_id", "pre"]).join(seen, ["doc_id", "pre"])
    return out.select(F.col("id").cast("long").alias("event_id"), (F.col("sum_before") < 500).alias("early"), F.col("seen").cast("long").alias("seen"))


@query(f"WITH r AS (SELECT *, sum(value) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM {_E}), f AS (SELECT doc_id, min(p) AS p FROM r WHERE s > 300 GROUP BY 1) SELECT r.doc_id, count(*) AS n FROM r LEFT JOIN f ON r.doc_id = f.doc_id WHERE f.p IS NULL OR r.p <= f.p GROUP BY 1")
def iterate_with_break(spark, sf_dir):
    """xsl:iterate: items are taken until their sum is above 300."""
    e = _events(spark, sf_dir).withColumn("v", F.col("value").cast("double"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))
    out = grouping.iterate(e, ["doc_id"], ["pre"], "v", start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n")), lambda s: s["sum"] > 300)
    return out.select("doc_id", F.col("result.n").alias("n"))


@query(f"SELECT event_id, lag(event_id) OVER (PARTITION BY doc_id ORDER BY p) AS previous, lead(event_id) OVER (PARTITION BY doc_id ORDER BY p) AS following FROM {_E}")
def sibling_neighbours(spark, sf_dir):
    e = _events(spark, sf_dir).select("doc_id", "pre", F.col("id").cast("long").alias("event_id"))
    near = sinks.element_pairs(fixtures.nodes(spark, sf_dir, "event_xml"))
    out = e.join(near, ["doc_id", "pre"])
    for side in ("previous", "following"):
        out = out.join(e.select("doc_id", F.col("pre").alias(side), F.col("event_id").alias(f"{side}_id")), ["doc_id", side], "left")
    return out.select("event_id", F.col("previous_id").alias("previous"), F.col("following_id").alias("following"))


@query("SELECT o_orderkey AS doc_id, o_totalprice AS total, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 20")
def sort_top(spark, sf_dir):
    """xsl:sort by number, descending, then the first twenty: TakeOrderedAndProject."""
    from pyspark.sql import Window

    o = attributes(fixtures.nodes(spark, sf_dir, "order_xml"), "order", ["total"]).select("doc_id", F.col("total").cast("double").alias("total"))
    top = grouping.sort_items(o, (F.col("total"), True, True), tie=["doc_id"]).limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("total").desc(), "doc_id")).cast("long"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE c > 1 GROUP BY 1")
def constraint_unique(spark, sf_dir):
    return _per_doc(constraints.unique(_lines(spark, sf_dir), ["doc_id"], ["no"]))


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM (SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE c > 1 GROUP BY 1")
def constraint_key(spark, sf_dir):
    return _per_doc(constraints.key(_lines(spark, sf_dir), ["doc_id"], ["part"]))


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1")
def constraint_keyref(spark, sf_dir):
    parts = fixtures.table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("part"))
    return _per_doc(constraints.keyref(_lines(spark, sf_dir), ["part"], parts, ["part"]))


@query("WITH v AS (SELECT l_orderkey AS doc_id, CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END AS a, CASE WHEN NOT l_discount < 0.09 THEN 'discount' END AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), u AS (SELECT doc_id, a AS rule FROM v UNION ALL SELECT doc_id, b FROM v) SELECT rule, count(*) AS n FROM u WHERE rule IS NOT NULL GROUP BY 1")
def schematron_asserts(spark, sf_dir):
    out = constraints.asserts(_lines(spark, sf_dir), quantity=F.col("qty").cast("double") <= 45, discount=F.col("disc").cast("double") < 0.09)
    return out.groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS bad_status, count(*) FILTER (o_totalprice > 300000) AS bad_total, 0::BIGINT AS bad_date FROM orders")
def schema_facets(spark, sf_dir):
    o = attributes(fixtures.nodes(spark, sf_dir, "order_xml"), "order", ["status", "total", "date"])
    bad = [
        constraints.facets(o, "status", "string", "bad_status", enumeration=["F", "O"]),
        constraints.facets(o, "total", "double", "bad_total", high=300000),
        constraints.facets(o, "date", "date", "bad_date"),
    ]
    every = bad[0].unionByName(bad[1]).unionByName(bad[2])
    return every.agg(*[F.count(F.when(F.col("rule") == r, 1)).alias(r) for r in ("bad_status", "bad_total", "bad_date")])


@query(f"SELECT o_orderkey AS doc_id, 1::BIGINT AS n FROM orders LEFT JOIN {_N} ON doc_id = o_orderkey WHERE coalesce(n, 0) NOT BETWEEN 1 AND 6")
def content_model(spark, sf_dir):
    return _per_doc(constraints.content_model(fixtures.nodes(spark, sf_dir, "order_xml"), {"order": "(line ){1,6}", "line": ""}))


@query("SELECT o_orderkey AS doc_id, (o_orderkey % 3 <> 0) AS wellformed FROM orders")
def parse_facts(spark, sf_dir):
    return xml.document_facts(fixtures.bad_xml(spark, sf_dir)).select("doc_id", "wellformed")


@query(f"SELECT o_orderkey AS doc_id, 2 + 2 * (1 + coalesce(n, 0)) + 6 + 7 * coalesce(n, 0) AS n FROM orders LEFT JOIN {_N} ON doc_id = o_orderkey")
def event_stream(spark, sf_dir):
    return _per_doc(xml.events(fixtures.nodes(spark, sf_dir, "order_xml")))


@query("SELECT conv_id AS doc_id, role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL")
def string_values(spark, sf_dir):
    nodes = fixtures.nodes(spark, sf_dir, "talk_xml")
    turns = attributes(nodes, "turn", ["role"]).withColumn("kind", F.lit(xml.ELEM)).withColumn("value", F.lit(None).cast("string"))
    text = axes.string_value(turns, nodes)
    return text.groupBy("doc_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    "SELECT conv_id AS doc_id, '<conv id=\"' || conv_id || '\">' || string_agg('<turn n=\"' || turn || '\" role=\"' || role || '\"' || CASE WHEN text = '' THEN '/>' ELSE '>' || "
    "replace(replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</turn>' END, '' ORDER BY turn, text) || '</conv>' AS xml FROM conversations GROUP BY 1"
)
def serialize_xml(spark, sf_dir):
    return sinks.serialize(fixtures.nodes(spark, sf_dir, "talk_xml"))


@query()
def canonical_xml(spark, sf_dir):
    return sinks.serialize(fixtures.nodes(spark, sf_dir, "geo_xml"), canonical=True)


@query("SELECT count(*) AS n, count(DISTINCT json_extract_string(j, '$.attributes.id')) AS ids FROM (SELECT '{\"attributes\":{\"id\":\"' || s_suppkey || '\"}}' AS j FROM supplier)")
def json_output(spark, sf_dir):
    j = sinks.to_json(fixtures.nodes(spark, sf_dir, "geo_xml")).where(F.get_json_object("json", "$.name") == "supplier")
    return j.agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("json", "$.attributes.id")).alias("ids"))


@query()
def html_links(spark, sf_dir):
    """Links of the HTML pages: page, target, text."""
    x = XPath(fixtures.html_nodes(spark, sf_dir))
    a = x.values("//a[@href]").select("doc_id", "pre", "text")
    href = x.select("//a/@href").select("doc_id", F.col("parent").alias("pre"), F.col("value").alias("href"))
    return a.join(href, ["doc_id", "pre"]).select("doc_id", "href", "text")


@query("SELECT page_id AS doc_id, 1::BIGINT AS n FROM pages")
def html_implied_body(spark, sf_dir):
    return _per_doc(XPath(fixtures.html_nodes(spark, sf_dir)).select("/html/body"))


@query("SELECT n_name AS name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def struct_decode(spark, sf_dir):
    """Regular documents straight into typed structs, without a node table."""
    schema = "region ARRAY<STRUCT<_id: INT, _name: STRING, nation: ARRAY<STRUCT<_id: INT, _name: STRING, supplier: ARRAY<STRUCT<_id: BIGINT, _VALUE: STRING>>>>>>"
    world = fixtures.geo_xml(spark, sf_dir).select(F.from_xml("xml", schema).alias("w"))
    region = world.select(F.explode("w.region").alias("r"))
    nation = region.select(F.explode("r.nation").alias("n"))
    return nation.select(F.col("n._name").alias("name"), F.coalesce(F.size("n.supplier"), F.lit(0)).cast("long").alias("n"))


@query("SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region)")
def path_with_context(spark, sf_dir):
    x = XPath(fixtures.nodes(spark, sf_dir, "geo_xml"))
    names = fixtures.table(spark, sf_dir, "region").agg(F.min("r_name").alias("first"))
    context = x.select("/world/region").join(names, F.col("attrs")["name"] == F.col("first"), "left_semi")
    return x.select("nation/@name", context).select(F.col("value").alias("name"))
