"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a sequence of names into phrases: every name is
compared with its left neighbour, the lowest differing bit gives a smaller label, and
after a few rounds labels are below six, so that local maxima lie at most a dozen
symbols apart. A cut depends on a handful of neighbours only, hence equal substrings
get equal phrases in their interior wherever they stand. The name of a phrase is a
hash of its content, so names agree between documents and workers without a shared
dictionary. Levels are stacked; phrases of level 3 span about 25 characters.

Every text, whatever its length, is described by the phrases of all levels that it has: those of level 1, and of the levels above it the
phrases that lie within the text, since the first and the last one depend on where the text ends. Each level has slots of its own,
the higher ones more of them. A fingerprint keeps for each slot, a part of the hash space, the smallest
name that falls there (16 bits, four hex digits); likeness is the share of slots with
equal content among those that either fingerprint fills. As a text grows the higher levels fill one slot after the other, so a few characters more change few slots.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Powers of two of the slots of levels 1, 2, ...
LEVEL_BITS = (2, 4, 5, 6)
SLOTS = sum(1 << b for b in LEVEL_BITS)
EMPTY = 0xFFFF
CHUNK_CHARS = 1 << 21
_LOWEST = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def _toss_table(size: int) -> np.ndarray:
    left, right = np.meshgrid(np.arange(size, dtype=np.uint16), np.arange(size, dtype=np.uint16), indexing="ij")
    diff = left ^ right
    low = np.bitwise_count((diff & (~diff + np.uint16(1))) - np.uint16(1)).astype(np.uint16)
    low[diff == 0] = 0
    return (2 * low + ((right >> low) & 1)).astype(np.uint8)


_TOSS = _toss_table(128)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below eight, unequal for neighbours of unequal names. first: places of the documents' first names."""
    diff = names.copy()
    diff[1:] ^= names[:-1]
    diff[first] = 1
    low = np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1))
    low[low > 63] = 0
    label = (2 * low + ((names >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        pair = np.empty(len(label), np.uint16)
        pair[1:] = label[:-1]
        pair[first] = label[first] ^ 1
        label = _TOSS.ravel()[(pair << 7) | label]
    return label


def _level(names: np.ndarray, starts: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """One level up: (phrase names, places where documents start). All documents have a name at least."""
    keep = np.empty(len(names), bool)
    keep[0] = True
    np.not_equal(names[1:], names[:-1], out=keep[1:])
    keep[starts] = True
    at = np.flatnonzero(keep)
    if len(at) < len(names):  # a run of one name becomes one name of its own
        run = np.diff(at, append=len(names)).astype(np.uint64)
        starts = np.searchsorted(at, starts)
        names = names[at]
        long = run > 1
        names[long] = _mix(names[long] + run[long] * np.uint64(0xA0761D6478BD642F))
    label = _labels(names, starts)
    cut = np.zeros(len(names), bool)
    if len(names) > 2:
        cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = starts[1:] - 1
    cut[last] = False  # the right neighbour belongs to another document
    cut[starts] = True
    at = np.flatnonzero(cut)
    place = np.arange(len(names), dtype=np.uint64) - np.repeat(at, np.diff(at, append=len(names))).astype(np.uint64)
    mixed = _mix(names + (place + np.uint64(salt + 1)) * np.uint64(0x8EBC6AF09C88C6E3))
    return _mix(np.add.reduceat(mixed, at)), np.searchsorted(at, starts)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of ``SLOTS`` 16-bit numbers for each text; an empty text has all of them ``EMPTY``."""
    out = np.full(len(texts) * SLOTS, EMPTY, np.uint16)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    own = np.flatnonzero(lengths)
    if not len(own):
        return out.reshape(-1, SLOTS)
    lengths = lengths[own]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    names = _mix(code.astype(np.uint64) + np.uint64(0x1D8E4E27C47D124F))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    first = 0
    for level, bits in enumerate(LEVEL_BITS, 1):
        names, starts = _level(names, starts, level)
        used = np.ones(len(names), bool)
        if level > 1:
            used[starts] = False
            used[np.append(starts[1:], len(names)) - 1] = False
        doc = np.repeat(own, np.diff(starts, append=len(names)))[used]
        value = names[used]
        slot = doc * SLOTS + first + (value >> np.uint64(64 - bits)).astype(np.int64)
        np.minimum.at(out, slot, (((value >> np.uint64(20)) & np.uint64(0xFFFF)) % np.uint64(EMPTY)).astype(np.uint16))
        first += 1 << bits
    return out.reshape(-1, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: the share of equal slots among those that either fills; 1 for two empty fingerprints."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    return np.where(filled == 0, 1.0, equal / np.maximum(filled, 1))


def _hex(rows: np.ndarray) -> list[str]:
    text = np.ascontiguousarray(rows.astype(">u2")).tobytes().hex()
    return [text[i : i + 4 * SLOTS] for i in range(0, len(text), 4 * SLOTS)]


def fingerprint_column(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint) of each row; a null text counts as empty. Repeated rows stay."""
    kind = texts.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            rows = [x or "" for x in batch.column(1).to_pylist()]
            for at, to in _chunks(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(_hex(fingerprints(rows[at:to])))], [id_col, "fingerprint"])

    return texts.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("fingerprint", T.StringType())]))


def _chunks(rows: list[str]):
    at, size = 0, 0
    for i, x in enumerate(rows):
        if size and size + len(x) > CHUNK_CHARS:
            yield at, i
            at, size = i, 0
        size += len(x)
    if rows:
        yield at, len(rows)


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """(pid, ahead, key, doc_id, text) dealt so that within ``pid`` each row is followed by the next one in descending doc_id.

    Bounds are actual ids, so a row that opens a bucket is known by its id alone; it
    is sent to the bucket before as well, marked ``ahead`` (the very first row to the last
    bucket). The text is shuffled once; only the bounds, one per partition, reach the driver.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / partitions for i in range(1, partitions)]
    found = docs.agg(F.max("key").alias("top"), F.percentile_approx("key", F.array(*[F.lit(x) for x in shares]) if shares else F.array(F.lit(0.5)), F.lit(10 * partitions)).alias("at")).first()
    bounds = np.array(sorted({found["top"], *(found["at"] if shares else [])} if found["top"] is not None else {0}), np.int64)
    n = len(bounds)

    @F.pandas_udf("array<int>")
    def dealt(key: pd.Series) -> pd.Series:
        keys = key.to_numpy(np.int64)
        at = np.searchsorted(bounds, keys)  # bounds ascend; the bucket of a bound holds it and what lies below, down to the one before
        opens = bounds[np.minimum(at, n - 1)] == keys
        bucket = n - 1 - at
        return pd.Series([[int(b), -1 - int((b - 1) % n)] if o else [int(b)] for b, o in zip(bucket, opens, strict=True)])

    rows = docs.withColumn("to", F.explode(dealt("key"))).select(
        F.when(F.col("to") >= 0, F.col("to")).otherwise(-1 - F.col("to")).alias("pid"), (F.col("to") < 0).alias("ahead"), "key", "doc_id", "text"
    )
    return rows.repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "ahead", F.col("key").desc(), "text")


def edited_text(text: str, following: str) -> str:
    """The last floor(n/3) code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches):
    rows: list[tuple] = []
    size = 0

    def flush(final: bool):
        nonlocal rows, size
        texts = [x[3] for x in rows]
        use = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        prints = fingerprints(texts)
        edited = [edited_text(texts[i], texts[i + 1]) for i in use]
        edited_prints = fingerprints(edited)
        own, after = prints[use], prints[[i + 1 for i in use]]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in use], pa.int64()),
                pa.array([len(texts[i]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
                pa.array(_hex(own), pa.string()),
                pa.array(_hex(edited_prints), pa.string()),
                pa.array(likeness(own, edited_prints), pa.float64()),
                pa.array(likeness(own, after), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
        rows = [] if final else rows[-1:]
        size = sum(len(x[3]) for x in rows)
        return out

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("pid", "ahead", "doc_id", "text")]
        for row in zip(*columns, strict=True):
            rows.append(row)
            size += len(row[3])
            if size > CHUNK_CHARS and len(rows) > 1:
                yield flush(False)
    if rows:
        yield flush(True)


def compare_with_edits(docs: DataFrame, partitions: int) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is empty, a null doc_id comes last in the
    descending order; rows with one doc_id follow each other by text, and repeated
    rows each give a row. A single row is its own next one. No rows give no rows.
    """
    return with_next(docs, partitions).select("pid", "ahead", "doc_id", "text").mapInArrow(_compare, _RESULT)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_with_edits(docs, common.shuffle_partitions(spark))


ORACLE = None
