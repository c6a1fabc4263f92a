"""Document collections made from the base tables, and their node tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.sources import xml

_made: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task computes columns for.
SPREAD_ROWS = 50_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows of a table dealt by its key to tasks of their own: a file of few bytes is one task however many rows it has."""
    n = rows.count() // SPREAD_ROWS
    return rows.repartition(n, key) if n > 1 else rows


def shared(spark: SparkSession) -> str:
    """Folder that every executor can reach: that of ``spark.checkpoint.dir``; a temporary one only where driver and executor are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return "file://" + tempfile.mkdtemp(prefix="nodeloom-nodes-")


#: Rows of base tables that a bucket of a node table is made for.
BUCKET_ROWS = 150_000


def bucket_count(spark: SparkSession, sf_dir: str, *names: str, weight: int = 1) -> int:
    """Buckets for a collection made from these tables; weight: how many rows of an order or a line one of their rows counts as."""
    rows = weight * sum(table(spark, sf_dir, x).count() for x in names)
    return max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))


def by_document(spark: SparkSession, holds: bool = True) -> None:
    """Joins by doc_id and a place take both sides as they are dealt by doc_id alone. A document is one group either way; by default Spark would deal both sides anew by all keys of each join.

    Not where a plan has many joins: all of them would be one stage, and its sorts hold memory at the same time.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", str(not holds).lower())


def bucketed(rows: DataFrame, n: int, path: str) -> DataFrame:
    """The rows as a table with ``n`` buckets of doc_id: joins, groups and windows within documents need no exchange."""
    by_document(rows.sparkSession)
    name = f"nodeloom_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(n, "doc_id").option("path", path).saveAsTable(name)
    out = rows.sparkSession.table(name)
    out.buckets = n
    return out


class Results:
    """A table in the shared folder that jobs add rows to, in the buckets of the node table that they come from."""

    def __init__(self, spark: SparkSession, n: int | None):
        self.spark, self.n = spark, n or int(spark.conf.get("spark.sql.shuffle.partitions"))
        by_document(spark)
        self.name, self.path = f"nodeloom_{uuid.uuid4().hex}", f"{shared(spark)}/results-{uuid.uuid4().hex}"

    def add(self, rows: DataFrame) -> None:
        rows.write.format("parquet").mode("append").bucketBy(self.n, "doc_id").option("path", self.path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)


def stored(spark: SparkSession, sf_dir: str, name: str, n: int, make) -> DataFrame:
    """A node table made once a session from ``xml.trees`` and kept in the shared folder, in buckets: documents are shredded once and queried often."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = bucketed(make(), n, f"{shared(spark)}/{name}-{uuid.uuid4().hex}")
    out = xml.node_table(_made[key])
    out.buckets = _made[key].buckets
    return out


def escaped(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tag(name: str, attributes: dict[str, Column | str], content: Column | str | None = None, plain: tuple[str, ...] = ()) -> Column:
    """An element as a string column. plain: attributes that are numbers or dates, in which nothing is to be escaped: each replacement makes the generated code longer, and beyond 8,000 bytes the JVM does not compile it."""
    head: list[Column] = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        value = (F.col(v) if isinstance(v, str) else v).cast("string")
        head += [F.lit(f' {k}="'), value if k in plain else escaped(value), F.lit('"')]
    if content is None:
        return F.concat(*head, F.lit("/>"))
    return F.concat(*head, F.lit(">"), F.col(content) if isinstance(content, str) else content, F.lit(f"</{name}>"))


LINE = {"no": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey", "qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "ret": "l_returnflag"}
_NUMBERS = ("no", "part", "supp", "qty", "price", "disc")


def order_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): one document an order, lines in the order of all their columns. Both tables are dealt by order alone, as the node table's buckets are."""
    n = bucket_count(spark, sf_dir, "orders", "lineitem")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), *LINE.values()).repartition(n, "l_orderkey")
    line = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE.values(), tag("line", LINE, plain=_NUMBERS).alias("xml")))).alias("lines"))
    line = line.select("l_orderkey", F.array_join(F.col("lines.xml"), "").alias("lines"))
    orders = table(spark, sf_dir, "orders").withColumn("o_orderkey", F.col("o_orderkey").cast("long")).repartition(n, "o_orderkey").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = {"id": "o_orderkey", "cust": "o_custkey", "status": "o_orderstatus", "total": "o_totalprice", "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "priority": "o_orderpriority"}
    return orders.select(F.col("o_orderkey").alias("doc_id"), tag("order", head, F.coalesce("lines", F.lit("")), ("id", "cust", "total", "date")).alias("xml"))


def event_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): one document a user, events in the order of time."""
    e = table(spark, sf_dir, "events")
    item = tag("e", {"id": "event_id", "type": "event_type", "value": "value"}, plain=("id", "value"))
    e = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", item.alias("xml")))).alias("es"))
    return e.select(F.col("user_id").alias("doc_id"), tag("user", {"id": "user_id"}, F.array_join(F.col("es.xml"), "")).alias("xml"))


def geo_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): one document of four levels."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", tag("supplier", {"id": "s_suppkey"}, escaped("s_name")).alias("xml")))).alias("x"))
    s = s.select("s_nationkey", F.array_join(F.col("x.xml"), "").alias("suppliers"))
    n = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    n = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", tag("nation", {"id": "n_nationkey", "name": "n_name"}, F.coalesce("suppliers", F.lit(""))).alias("xml")))).alias("x"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    r = r.agg(F.sort_array(F.collect_list(F.struct("r_regionkey", tag("region", {"id": "r_regionkey", "name": "r_name"}, F.coalesce(F.array_join(F.col("x.xml"), ""), F.lit(""))).alias("xml")))).alias("x"))
    return r.select(F.lit(0).cast("long").alias("doc_id"), tag("world", {}, F.array_join(F.col("x.xml"), "")).alias("xml"))


def talk_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): one document a conversation."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", tag("turn", {"n": "turn", "role": "role"}, escaped("text")).alias("xml")))).alias("x"))
    return t.select(F.col("conv_id").alias("doc_id"), tag("conv", {"id": "conv_id"}, F.array_join(F.col("x.xml"), "")).alias("xml"))


def bad_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_xml`` with every third document cut off before its end."""
    cut = F.expr("substring(xml, 1, length(xml) - 4)")
    return order_xml(spark, sf_dir).withColumn("xml", F.when(F.col("doc_id") % 3 == 0, cut).otherwise(F.col("xml")))


MAKERS = {"order_xml": order_xml, "event_xml": event_xml, "geo_xml": geo_xml, "talk_xml": talk_xml}
_FROM = {"order_xml": ("orders", "lineitem"), "event_xml": ("events",), "geo_xml": ("supplier",), "talk_xml": ("conversations",)}


def nodes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Node table of a collection."""
    n = bucket_count(spark, sf_dir, *_FROM[name])

    def make():
        docs = MAKERS[name](spark, sf_dir)
        return xml.trees(docs if name == "order_xml" else docs.repartition(n, "doc_id"))

    return stored(spark, sf_dir, f"nodes-{name}", n, make)


def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bucket_count(spark, sf_dir, "pages", weight=100)
    return stored(spark, sf_dir, "nodes-html", n, lambda: xml.trees(table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("long")).repartition(n, "page_id"), "page_id", "html", html=True))
