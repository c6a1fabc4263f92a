"""Corpus pipeline: language ID, SimHash near-duplicates, surrogates for personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import common, language, mixing, packing, pii, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_number_of(columns: list[str]) -> F.Column:
    """A hash that differs for rows that differ."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull())))


#: Rows that go to a Python worker at once: batches of whole texts are held by the JVM and the worker at the same time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the decoded language. Documents without a letter go, and those whose decoding is ambiguous (``language.AMBIGUOUS_BELOW``).

    Without any label to learn from, nothing is decoded: documents with a letter stay as they are.
    """
    small_batches(spark)
    model = language.train(docs.where(~language.held_out("doc_id")))
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}")).select(*COLUMNS)
    found = language.identify(docs, model, COLUMNS).where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous"))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (at least 0.8 of all their five-word shingles in common, compared exactly) the row with the smallest id stays; rows without an id stay.

    Rows that share an id and differ are told apart by a hash of all columns; of equal rows one stays.
    """
    small_batches(spark)
    rows = docs.select(*COLUMNS).withColumn("row", row_number_of(COLUMNS))
    first, _ = common.store(simhash.first_of_near_copies(rows.select("doc_id", "row", "text")), "first")
    kept = rows.join(first, ["doc_id", "row"])
    if not first.where("copies > 1").isEmpty():
        kept = kept.where("copies = 1").unionByName(kept.where("copies > 1").dropDuplicates(["doc_id", "row"]))
    return kept.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs.select(*COLUMNS)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one in which a source's budget ends is cut to the words that are left."""
    rows = docs.select(*COLUMNS).withColumn("row", row_number_of(COLUMNS))
    taken = mixing.mix(rows.select("doc_id", "text", "source", "row"), keep=("row",)).groupBy("row")
    taken = taken.agg(F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("copies")).where(F.col("taken") > 0)
    taken, _ = common.store(taken, "taken")
    if not taken.where("copies > 1").isEmpty():  # equal rows are taken together
        again = rows.join(taken.where("copies > 1").select("row"), "row", "left_semi").dropDuplicates(["row"])
        rows = rows.join(taken.where("copies > 1").select("row"), "row", "left_anti").unionByName(again)
    rows = rows.join(taken, "row")
    words = F.split(F.trim(F.translate("text", "\t\n\x0b\x0c\r", " " * 5)), " +")
    part = (F.col("taken") % F.col("size")).cast("int")
    whole = F.array_repeat(F.col("text"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    cut = F.when(part > 0, F.array(F.array_join(F.slice(words, F.lit(1), part), " "))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", "lang", "source", F.explode(F.concat(whole, cut)).alias("text"))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("surrogates", surrogates),
    ("mixing_sources", mixing_sources),
    ("packing_sequences", packing_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = common.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
