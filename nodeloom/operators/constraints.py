"""Constraints as queries for violations: (doc_id, pre, rule, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.sources.xml import ATTR, ELEM


def _found(rows: DataFrame, rule: str, message: Column) -> DataFrame:
    return rows.select("doc_id", "pre", F.lit(rule).alias("rule"), message.alias("message"))


def unique(items: DataFrame, host: list[str], fields: list[str], rule: str = "unique") -> DataFrame:
    """Every item whose whole key occurs more than once in its host; items without a field are left out."""
    whole = items.where(F.forall(F.array(*[F.col(f).isNull() for f in fields]), lambda x: ~x))
    twice = whole.groupBy(*host, *fields).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return _found(whole.join(twice, [*host, *fields], "left_semi"), rule, F.concat_ws("|", *fields))


def key(items: DataFrame, host: list[str], fields: list[str], rule: str = "key") -> DataFrame:
    """As ``unique``; a missing field is a violation too."""
    missing = F.exists(F.array(*[F.col(f).isNull() for f in fields]), lambda x: x)
    return unique(items, host, fields, rule).unionByName(_found(items.where(missing), rule, F.lit("missing field")))


def keyref(items: DataFrame, fields: list[str], keys: DataFrame, key_fields: list[str], host: list[str] = (), rule: str = "keyref") -> DataFrame:
    """Items whose key is not among ``keys``."""
    k = keys.select(*host, *[F.col(c).alias(f"__k{i}") for i, c in enumerate(key_fields)]).distinct()
    on = [F.col(f) == F.col(f"__k{i}") for i, f in enumerate(fields)]
    if host:
        k = k.select(*[F.col(h).alias(f"__h{i}") for i, h in enumerate(host)], *[f"__k{i}" for i in range(len(fields))])
        on += [F.col(h) == F.col(f"__h{i}") for i, h in enumerate(host)]
    return _found(items.join(k, on, "left_anti"), rule, F.concat_ws("|", *fields))


def asserts(items: DataFrame, **tests: Column) -> DataFrame:
    """Schematron-like: a row for each item and named test that fails or is unknown; all tests in one pass."""
    fails = F.filter(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return items.select("doc_id", "pre", F.explode(fails).alias("rule")).withColumn("message", F.lit("assertion failed"))


#: Built-in simple types by their lexical form.
SIMPLE = {
    "integer": "^[+-]?[0-9]+$",
    "decimal": "^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$",
    "double": "^([+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([Ee][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "boolean": "^(true|false|0|1)$",
    "date": "^-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "NCName": "^[A-Za-z_][A-Za-z0-9._-]*$",
}


def facets(values: DataFrame, column: str, base: str, rule: str = "facet", *, pattern: str | None = None, enumeration: list[str] | None = None, low: float | None = None, high: float | None = None, length: int | None = None, most: int | None = None, digits: int | None = None) -> DataFrame:
    """Values outside a simple type: lexical form, pattern, enumeration, bounds, length, largest length, total digits."""
    v = F.trim(F.col(column))
    ok = v.rlike(SIMPLE[base]) if base in SIMPLE else F.lit(True)
    if pattern:
        ok = ok & v.rlike(f"^(?:{pattern})$")
    if enumeration:
        ok = ok & v.isin(*enumeration)
    number = v.try_cast("double")
    if low is not None:
        ok = ok & (number >= low)
    if high is not None:
        ok = ok & (number <= high)
    if length is not None:
        ok = ok & (F.length(v) == length)
    if most is not None:
        ok = ok & (F.length(v) <= most)
    if digits is not None:
        ok = ok & (F.length(F.regexp_replace(v, "[^0-9]", "")) <= digits)
    return _found(values.where(~F.coalesce(ok, F.lit(False))), rule, F.col(column))


def content_model(nodes: DataFrame, models: dict[str, str], rule: str = "content") -> DataFrame:
    """Elements whose child names don't match the regular expression for their name, over names each followed by a blank, e.g. ``(line )*``."""
    children = nodes.where(F.col("kind") == ELEM).select("doc_id", F.col("parent").alias("pre"), F.col("pre").alias("c_pre"), F.col("local").alias("c_local"))
    names = children.groupBy("doc_id", "pre").agg(F.sort_array(F.collect_list(F.struct("c_pre", "c_local"))).alias("c"))
    names = names.select("doc_id", "pre", F.array_join(F.transform("c", lambda x: F.concat(x["c_local"], F.lit(" "))), "").alias("names"))
    hosts = nodes.where((F.col("kind") == ELEM) & F.col("local").isin(*models)).select("doc_id", "pre", "local").join(names, ["doc_id", "pre"], "left")
    ok = F.lit(None)
    for name, model in models.items():
        ok = F.when(F.col("local") == name, F.coalesce("names", F.lit("")).rlike(f"^(?:{model})$")).otherwise(ok)
    return _found(hosts.where(~ok), rule, F.coalesce("names", F.lit("")))


def attribute_use(nodes: DataFrame, element: str, *, required: list[str] = (), prohibited: list[str] = (), fixed: dict[str, str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Elements called ``element`` whose attributes break a declaration: missing, prohibited, other than fixed, or (with ``allowed``) not declared. One pass over the attributes."""
    hosts = nodes.where((F.col("kind") == ELEM) & (F.col("local") == element)).select("doc_id", "pre")
    have = nodes.where(F.col("kind") == ATTR).groupBy("doc_id", F.col("parent").alias("pre")).agg(F.map_from_entries(F.collect_list(F.struct("local", "value"))).alias("a"))
    rows = hosts.join(have, ["doc_id", "pre"], "left").withColumn("a", F.coalesce("a", F.create_map().cast("map<string,string>")))
    value = lambda n: F.try_element_at("a", F.lit(n))
    known = {*(allowed or ()), *required, *(fixed or {})}
    bad = [
        *[F.when(value(n).isNull(), F.lit(f"required {n}")) for n in required],
        *[F.when(value(n).isNotNull(), F.lit(f"prohibited {n}")) for n in prohibited],
        *[F.when(value(n) != v, F.lit(f"fixed {n}")) for n, v in (fixed or {}).items()],
    ]
    found = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array().cast("array<string>")
    if allowed is not None:
        found = F.concat(found, F.transform(F.filter(F.map_keys("a"), lambda k: ~k.isin(*known)), lambda k: F.concat(F.lit("undeclared "), k)))
    return rows.select("doc_id", "pre", F.explode(found).alias("rule")).withColumn("message", F.lit("attribute"))


def idrefs(refs: DataFrame, id_table: DataFrame, column: str = "value") -> DataFrame:
    """References (each word of the column) to identifiers that their document does not have."""
    words = refs.select("doc_id", "pre", F.explode(F.split(F.trim(F.col(column)), "[ \t\r\n]+")).alias("id"))
    return _found(words.join(id_table, ["doc_id", "id"], "left_anti"), "IDREF", F.col("id"))


def reports(items: DataFrame, lets: dict[str, Column] | None = None, **tests: tuple[Column, Column]) -> DataFrame:
    """Schematron reports: a row where a test holds, with its own message; ``lets`` are bound one after another and may be used by tests and messages."""
    for name, value in (lets or {}).items():
        items = items.withColumn(name, value)
    fired = F.filter(F.array(*[F.when(t, F.struct(F.lit(n).alias("rule"), m.alias("message"))) for n, (t, m) in tests.items()]), lambda x: x.isNotNull())
    return items.select("doc_id", "pre", F.explode(fired).alias("r")).select("doc_id", "pre", "r.rule", "r.message")
