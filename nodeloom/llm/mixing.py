"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets come from a water level over the table of sources (one row each). Within a
source, complete epochs precede fractional selection: every document is taken
floor(target / source size) times, and the rest of the target is filled in the
order of exponential keys -ln(u) / w, where u comes from a hash of the document's id
and w is its quality weight. The prefix sum is not run over a whole source in
one task: keys are cut into buckets of equal chance, sizes are summed by (source,
bucket), and only the one bucket in which the budget ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2.0
BUCKETS = 4096
SEED = "mix-1"


def word_count(text: Column | str) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    spaced = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.coalesce(F.regexp_count(spaced, F.lit("[^ ]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the id, by md5, so that other engines can repeat it."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def quality_weight(n_chars: Column, words: Column) -> Column:
    """Between 0.1 and 1: highest for texts whose words have about six characters with the space after them."""
    return F.lit(0.1) + F.lit(0.9) / (F.lit(1.0) + F.abs(n_chars / F.greatest(words, F.lit(1)) - F.lit(6.0)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share``
    times all sizes; no target exceeds ``most`` times its source's size, the excess going to the
    others by weight. Passing on an excess again and again ends at a water level: target =
    min(cap, level x weight), found in one pass over the sources ordered by cap / weight.
    """
    every = Window.partitionBy(F.lit(0))
    ordered = every.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = every.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    # the first source that the level does not fill, if any, sets it
    rows = rows.withColumn("place", F.row_number().over(by_ratio))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))
    rows = rows.withColumn("water", F.min(fits).over(every)["level"])
    return rows.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and the columns ``keep`` of each row of (doc_id, text, source).

    Sizes are words; a null text has none. ``taken`` counts repeats: complete epochs
    give every document its size, then documents follow in the order of their keys, and the one in which the budget
    ends gives the words that are left. Rows that repeat an id have one key: they are ordered by size, by the columns ``keep`` and then as they come, so equal rows
    share the outcome among them. A source without words has target 0. No rows give no rows.
    """
    size = word_count("text")
    rows = docs.select("doc_id", "source", *keep, size.alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    rows = rows.select("doc_id", "source", *keep, "size", (-F.log(uniform(F.col("doc_id"))) / quality_weight(F.col("n_chars"), F.col("size"))).alias("key"))
    # 1 - exp(-key): even over (0, 1) for weight 1, so buckets hold like numbers of rows
    rows = rows.withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets).cast("int"))
    rows, _ = common.store(rows, "mix")
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goal = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("budget", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = by_bucket.withColumn("upto", F.sum("words").over(up_to)).join(goal, by_bucket["source"].eqNullSafe(goal["source"])).select(goal["*"], "bucket", "words", "upto")
    ends = ends.groupBy("source", "source_size", "target", "epochs", "budget").agg(
        F.min(F.when(F.col("upto") > F.col("budget"), F.col("bucket"))).alias("last"),
        F.min(F.when(F.col("upto") > F.col("budget"), F.struct("upto", F.col("words").alias("within")))).alias("end"),
    )
    ends = ends.select(F.col("source").alias("of"), "source_size", "target", "epochs", "budget", "last", (F.col("end.upto") - F.col("end.within")).alias("before"))
    rows = rows.join(ends, rows["source"].eqNullSafe(ends["of"])).drop("of")
    inside = F.col("last").isNotNull() & (F.col("bucket") == F.col("last"))
    so_far = Window.partitionBy("source").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(inside).withColumn("left", F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(so_far), F.lit(0)))
    edge = edge.withColumn("extra", F.least("size", F.greatest("left", F.lit(0)))).drop("left")
    rest = rows.where(~inside).withColumn("extra", F.when(F.col("last").isNull() | (F.col("bucket") < F.col("last")), F.col("size")).otherwise(F.lit(0)))
    rest = rest.withColumn("extra", F.when(F.col("budget") > 0, F.col("extra")).otherwise(F.lit(0)))
    return edge.unionByName(rest).select("doc_id", *keep, "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, coalesce(length(text), 0) AS n_chars,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), k AS (SELECT *, -ln(u) / (0.1 + 0.9 / (1 + abs(n_chars::DOUBLE / greatest(size, 1) - 6))) AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM s
), g AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size
    - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_over
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(left_over, 0)))::BIGINT AS taken FROM r
"""
