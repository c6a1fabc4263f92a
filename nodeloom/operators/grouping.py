"""Grouping, merging, numbering and folding over ordered items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(c: Column, numeric: bool = False) -> Column:
    """Key under which equal values of different spellings meet: numbers as doubles (-0 as 0), strings as they are."""
    if numeric:
        d = c.cast("double")
        return F.when(d == 0, F.lit(0.0)).otherwise(d)
    return c.cast("string")


def group_by(items: DataFrame, keys: Column, order: list[str], *aggs: Column, multi: bool = False) -> DataFrame:
    """Groups in order of first appearance (``first_seen``). multi: ``keys`` is an array and an item joins each of its groups once; empty keys drop the item."""
    each = F.explode(F.array_distinct(keys)) if multi else keys
    rows = items.withColumn("grouping_key", each)
    rows = rows.where(F.col("grouping_key").isNotNull())
    return rows.groupBy("grouping_key").agg(F.min(F.struct(*order)).alias("first_seen"), *aggs)


def islands(items: DataFrame, within: list[str], order: list[str], opens: Column) -> DataFrame:
    """``items`` with ``group_no``, counted up where ``opens`` holds; what comes before the first is group 0."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("group_no", F.sum(F.when(opens, 1).otherwise(0)).over(w))


def group_adjacent(items: DataFrame, within: list[str], order: list[str], key: Column) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order)
    items = items.withColumn("__opens", ~key.eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1))
    return islands(items, within, order, F.col("__opens")).drop("__opens")


def group_starting_with(items: DataFrame, within: list[str], order: list[str], match: Column) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) == 1
    items = items.withColumn("__opens", first | match)
    return islands(items, within, order, F.col("__opens")).drop("__opens")


def group_ending_with(items: DataFrame, within: list[str], order: list[str], match: Column) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order)
    items = items.withColumn("__opens", F.coalesce(F.lag(match).over(w), F.lit(True)))
    return islands(items, within, order, F.col("__opens")).drop("__opens")


def merge(sources: dict[str, DataFrame], keys: list[str], *aggs: Column) -> DataFrame:
    """K-way merge of sources by key: one row a key, as in a full outer co-group; ``source`` tells where a row comes from."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.groupBy(*keys).agg(*aggs)


def unsorted_rows(source: DataFrame, order: list[str], key: str, within: list[str]) -> DataFrame:
    """Rows at which a merge source is out of order."""
    w = Window.partitionBy(*within).orderBy(*order)
    return source.withColumn("__before", F.lag(key).over(w)).where(F.col("__before") > F.col(key)).drop("__before")


def number_single(items: DataFrame) -> DataFrame:
    """Ordinal among siblings of one name."""
    return items.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "parent", "local").orderBy("pre")))


def number_any(items: DataFrame, resets: Column | None = None) -> DataFrame:
    """Running number in document order, starting again after rows where ``resets`` holds."""
    w = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.sum(F.when(resets, 1).otherwise(0)).over(w) if resets is not None else F.lit(0)
    items = items.withColumn("__part", part)
    return items.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "__part").orderBy("pre"))).drop("__part")


def number_multiple(items: DataFrame, counted: DataFrame) -> DataFrame:
    """Hierarchical number such as 2.1.3 from the ordinals of the ancestors in ``counted`` and the item itself."""
    a = number_single(counted).select(F.col("doc_id").alias("a_doc"), F.col("pre").alias("a_pre"), F.col("size").alias("a_size"), F.col("number").alias("a_number"))
    on = (F.col("doc_id") == F.col("a_doc")) & (F.col("a_pre") <= F.col("pre")) & (F.col("pre") <= F.col("a_pre") + F.col("a_size"))
    parts = items.join(a, on).groupBy("doc_id", "pre").agg(F.sort_array(F.collect_list(F.struct("a_pre", "a_number"))).alias("n"))
    return parts.select("doc_id", "pre", F.array_join(F.transform("n", lambda x: x["a_number"].cast("string")), ".").alias("number"))


def accumulate(nodes: DataFrame, value: Column, at_end: bool = False) -> DataFrame:
    """A summing accumulator with its values before and after each node; rules fire at the start of a node, or at its end."""
    w = Window.partitionBy("doc_id").orderBy("__at", "__depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.struct((F.col("pre") * 2).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("ends"))
    end = F.struct(((F.col("pre") + F.col("size")) * 2 + 1).alias("at"), (-F.col("level")).alias("depth"), F.lit(True).alias("ends"))
    rows = nodes.withColumn("__v", value).select("doc_id", "pre", "__v", F.explode(F.array(start, end)).alias("e"))
    rows = rows.select("doc_id", "pre", F.col("e.at").alias("__at"), F.col("e.depth").alias("__depth"), F.col("e.ends").alias("ends"), F.when(F.col("e.ends") == at_end, F.col("__v")).alias("__v"))
    rows = rows.withColumn("total", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    return rows.groupBy("doc_id", "pre").agg(F.max(F.when(~F.col("ends"), F.col("total"))).alias("before"), F.max(F.when(F.col("ends"), F.col("total"))).alias("after"))


def iterate(items: DataFrame, within: list[str], order: list[str], value: str, start: Column, step, stop, finish=None) -> DataFrame:
    """Sequential fold with early exit over each group's items: ``step(state, x)`` until ``stop(state)``, then ``finish(state)``."""
    rows = items.groupBy(*within).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__x")))), lambda s: s["__x"]).alias("__xs"))
    folded = F.aggregate("__xs", start, lambda s, x: F.when(stop(s), s).otherwise(step(s, x)), finish or (lambda s: s))
    return rows.select(*within, folded.alias("result"))


def sort_items(items: DataFrame, *keys: tuple[Column, bool, bool], tie: list[str]) -> DataFrame:
    """Stable sort by (key, descending, numeric): NaN and text that is no number come first when ascending, last when descending."""
    by = []
    for key, descending, numeric in keys:
        if numeric:
            number = F.coalesce(key.try_cast("double"), F.lit(float("nan")))
            nan, key = F.isnan(number), number
            by += [nan.asc(), key.desc()] if descending else [nan.desc(), key.asc()]
        else:
            by.append(key.desc() if descending else key.asc())
    return items.orderBy(*by, *tie)
