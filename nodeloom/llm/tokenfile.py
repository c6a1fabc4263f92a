"""Binary token output: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the order of falling corpus frequency, so that frequent ids are small.
Every rank takes 1 to 4 data bytes; two bits for each give that number, four to a control
byte, and control bytes stand apart from data bytes. Decoding looks the control bytes up in a
table of 256 x 4 lengths and gathers the data with numpy, without a loop over ids.

A set of files is a folder with two parquet tables: ``ranks`` (rank, id, n) and ``blocks``, whose binary
columns hold the coded blocks. A block has whole documents in ascending doc_id order: per document the
number of ids and of data bytes (unsigned 32-bit), then control bytes (each document starts a new one), then data.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, unit_tokens

END_ID = 1
CHUNK_BYTES = 1 << 22
BLOCK_BYTES = 1 << 20

#: Lengths of the four numbers that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def encode_all(numbers: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """(control, data, control bytes of each document, data bytes of each document) of documents with ``counts`` numbers each, in a row."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    size = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    slots = -(-counts // 4) * 4
    codes = np.zeros(int(slots.sum()), np.uint8)
    codes[np.arange(len(numbers)) + np.repeat(np.cumsum(slots - counts) - (slots - counts), counts)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])]
    return control.tobytes(), data.tobytes(), slots // 4, np.diff(ends)


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of the unsigned 32-bit numbers of one document."""
    return encode_all(numbers, np.array([len(numbers)]))[:2]


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all 16-bit ids of a binary column in a row, number of ids of each row)."""
    lengths = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int32, 1, 4 * column.offset)[0]) if len(column) else 0
    return np.frombuffer(data or b"", "<u2", int(lengths.sum()) // 2, first) if len(column) else np.zeros(0, "<u2"), lengths // 2


def _rows_of(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The bytes of ``data`` as a binary column of rows with ``lengths`` bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    kind, offset = (pa.binary(), np.int32) if ends[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    made = pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(ends.astype(offset)), pa.py_buffer(np.ascontiguousarray(data))])
    return made.cast(pa.binary())


def _cut(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths)
    return [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def decode_numbers(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The numbers of documents with ``counts`` numbers each, whose control and data bytes stand in a row."""
    slots = -(-counts // 4) * 4
    place = np.arange(int(slots.sum())) - np.repeat(np.cumsum(slots) - slots, slots)
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[place < np.repeat(counts, slots)]
    at = np.cumsum(size, dtype=np.int64) - size
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = padded[at]
    for j in (1, 2, 3):
        more = np.flatnonzero(size > j)
        out[more] |= padded[at[more] + j] << np.uint32(8 * j)
    return out


TOKENS = "doc_id long, ids binary, used array<long>, n array<long>"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, used, n): ids of the word vocabulary as little-endian unsigned 16-bit numbers, the end id last.

    The last row of a partition has, in place of a document's ids, the ids in use there and how often each stands in it.
    """

    names = [x.split()[0] for x in TOKENS.split(", ")]

    def run(batches):
        encoder = unit_tokens.encoder(tokenizer, True)
        if encoder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary does not fit 16 bits")
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for at, to in unit_tokens.chunks(batch.column(1), CHUNK_BYTES):
                ids, counts = encoder.encode(batch.column(1).slice(at, to - at))
                total += np.bincount(ids, minlength=1 << 16)
                total[end_id] += to - at
                last = np.cumsum(counts + 1) - 1
                data = np.empty(len(ids) + len(counts), "<u2")
                inner = np.ones(len(data), bool)
                inner[last] = False
                data[inner] = ids
                data[last] = end_id
                doc_ids = batch.column(0).slice(at, to - at).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids, _rows_of(data, 2 * (counts + 1)), pa.nulls(to - at, pa.list_(pa.int64())), pa.nulls(to - at, pa.list_(pa.int64()))], names)
        used = np.flatnonzero(total)
        counts = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (used, total[used])]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *counts], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENS)


def frequency_ranks(tokens: DataFrame) -> DataFrame:
    """(rank, id, n) over all documents: falling frequency, then id. It has a row for each id in use, so a vocabulary's size at most."""

    counts = tokens.where(F.col("used").isNotNull()).select(F.explode(F.arrays_zip(F.col("used").alias("id"), F.col("n").alias("n"))).alias("x"))
    counts = counts.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.n").alias("n"))
    return counts.select((F.row_number().over(Window.orderBy(F.col("n").desc(), "id")) - 1).cast("long").alias("rank"), "id", "n")


BLOCKS = "part int, before long, ids long, docs int, doc_ids array<long>, head binary, control binary, data binary"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode (doc_id, text) into the folder ``path``, in ascending doc_id order.

    A null text is empty and has only the end id. A null doc_id comes first; rows with one doc_id
    follow each other by content, and repeated rows are all kept. No rows give no blocks.
    """
    spark = docs.sparkSession
    at = f"{path}/tokens"
    tokenized(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(at)
    tokens = spark.read.schema(T._parse_datatype_string(TOKENS)).parquet(at)
    frequency_ranks(tokens).write.parquet(f"{path}/ranks")
    found = spark.read.schema("rank long, id long, n long").parquet(f"{path}/ranks").select("rank", "id").toArrow()
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[found.column("id").to_numpy()] = found.column("rank").to_numpy()
    held = spark.sparkContext.broadcast(rank_of)  # 256 KB

    def block(batches):
        part, before = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        size = 0

        def made():
            nonlocal rows, size, before
            ids = sum(x[1] for x in rows)
            head = np.array([(x[1], len(x[3])) for x in rows], "<u4").tobytes()
            values = [part, before, ids, len(rows), [x[0] for x in rows], head, b"".join(x[2] for x in rows), b"".join(x[3] for x in rows)]
            before += ids
            rows, size = [], 0
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            ids, counts = _joined(batch.column(1))
            control, data, control_bytes, data_bytes = encode_all(held.value[ids], counts)
            for row in zip(batch.column(0).to_pylist(), counts.tolist(), _cut(control, control_bytes), _cut(data, data_bytes), strict=True):
                rows.append(row)
                size += len(row[2]) + len(row[3])
                if size >= BLOCK_BYTES:
                    yield made()
        if rows:
            yield made()

    # ranges are drawn on the plain ids: their sample reads the table once more, and must not run the coding twice
    order = tokens.where(F.col("ids").isNotNull()).select("doc_id", "ids").repartitionByRange(common.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    order.mapInArrow(block, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    common.discard(spark, at)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the folder, and its ids (little-endian unsigned 32-bit) if ``with_ids``."""
    blocks = spark.read.schema(T._parse_datatype_string(BLOCKS)).parquet(f"{path}/blocks")
    found = spark.read.schema("rank long, id long, n long").parquet(f"{path}/ranks").select("rank", "id").toArrow()
    id_of = np.zeros(max(1, found.num_rows), "<u4")
    id_of[found.column("rank").to_numpy()] = found.column("id").to_numpy()
    start_of, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect():  # one row a partition
        start_of[r["part"]] = total
        total += r["ids"]
    held = spark.sparkContext.broadcast((id_of, start_of))

    def run(batches):
        id_of, start_of = held.value
        for batch in batches:
            for row in batch.to_pylist():
                head = np.frombuffer(row["head"], "<u4").reshape(-1, 2).astype(np.int64)
                counts = head[:, 0]
                ids = id_of[decode_numbers(row["control"], row["data"], counts)]
                ends = np.cumsum(counts)
                data = ids.tobytes()
                pieces = [data[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(start_of[row["part"]] + row["before"] + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(pieces, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{common.shared_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_token_files(spark, path)


ORACLE = None
