"""Harmonic packing of token sequences.

Lengths are partitioned into classes by the reciprocal of the capacity C = 1024: class j
holds lengths above C/(j+1), up to C/j, and each bin of class j takes exactly j pieces.
Documents may be cut, so a document is first cut into pieces of exactly C, C/2, ... C/16, whose
bins come out full, and one tail below 64 ids, which goes to its class as it is. Every task packs its own partition and nothing is
shuffled. At the end of a partition, pieces of an exact class that don't fill a bin
are put together in counts that are powers of two, so that those sequences have a length that needs no
padding, and left-over tails of all classes share bins next-fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common, unit_tokens

CAPACITY = 1024
END_ID = 0
#: Shortest piece that is cut off; what remains below it is the tail.
LEAST_CUT = 64
CHUNK_BYTES = 1 << 21
#: Units that a worker's encoder remembers.
REMEMBER = 300_000


class Packer:
    """Bins of one worker. Pieces come as rows of (place, length); ``take`` gives rows (place, sequence, offset) that are settled."""

    def __init__(self, capacity: int = CAPACITY, least: int = LEAST_CUT):
        self.capacity, self.least = capacity, least
        self.open: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.done: list[tuple[int, int, int]] = []
        self.sequence = 0

    def cuts(self, n: int) -> list[int]:
        """Lengths of the pieces of n ids, largest first."""
        out = [self.capacity] * (n // self.capacity)
        n %= self.capacity
        size = self.capacity // 2
        while size >= self.least:
            if n >= size:
                out.append(size)
                n -= size
            size //= 2
        if n:
            out.append(n)
        return out

    def close(self, pieces: list[tuple[int, int]]) -> None:
        offset = 0
        for place, length in pieces:
            self.done.append((place, self.sequence, offset))
            offset += length
        self.sequence += 1

    def add(self, place: int, length: int) -> None:
        j = self.capacity // length
        held = self.open.setdefault((j, length >= self.least), [])
        held.append((place, length))
        if len(held) == j:
            self.close(held)
            self.open[j, length >= self.least] = []

    def finish(self) -> None:
        """Close what is open at the end of a partition."""
        tails: list[tuple[int, int]] = []
        for (_, exact), held in sorted(self.open.items()):
            if not exact:
                tails += held
                continue
            while held:
                n = 1 << (len(held).bit_length() - 1)
                self.close(held[:n])
                held = held[n:]
        bin_, size = [], 0
        for piece in tails:
            if size + piece[1] > self.capacity:
                self.close(bin_)
                bin_, size = [], 0
            bin_.append(piece)
            size += piece[1]
        if bin_:
            self.close(bin_)
        self.open = {}

    def take(self) -> list[tuple[int, int, int]]:
        out, self.done = self.done, []
        return out


PIECE_FIELDS = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` (binary, little-endian
    unsigned 32-bit) if ``with_ids``.

    Each row of ``docs`` is packed, repeated ones too; a null text is empty and has only the end id. Sequence
    ids are (partition << 40) + number within it. No rows give no rows.
    """
    fields = [docs.schema[id_col], *(T.StructField(n, t) for n, t in PIECE_FIELDS), *([T.StructField("ids", T.BinaryType())] if with_ids else [])]
    names = [f.name for f in fields]

    def run(batches):
        common.hand_back()
        encoder = unit_tokens.encoder(tokenizer, False, REMEMBER)
        high = TaskContext.get().partitionId() << 40
        packer = Packer()
        waiting: dict[int, tuple] = {}
        place = 0

        def settled():
            got = packer.take()
            rows = [waiting.pop(p) for p, _, _ in got]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(5 + with_ids)]
            head = columns[:5]
            head[5:] = [[high + s for _, s, _ in got], [o for _, _, o in got], *columns[5:]]
            return pa.RecordBatch.from_arrays([pa.array(head[0], id_type), *(pa.array(c, pa.int64()) for c in head[1:7]), *(pa.array(c, pa.binary()) for c in head[7:])], names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            doc_ids = batch.column(0).to_pylist()
            for at, to in unit_tokens.chunks(batch.column(1), CHUNK_BYTES):
                ids, counts = encoder.encode(batch.column(1).slice(at, to - at))
                ids = ids.astype("<u4")
                edge = 0
                for doc_id, n in zip(doc_ids[at:to], counts.tolist(), strict=True):
                    data = ids[edge : edge + n].tobytes() + END_ID.to_bytes(4, "little")
                    edge += n
                    start = 0
                    for length in packer.cuts(n + 1):
                        piece = data[4 * start : 4 * (start + length)]
                        waiting[place] = (doc_id, start, length, zlib.crc32(piece), n + 1, *([piece] if with_ids else []))
                        packer.add(place, length)
                        place += 1
                        start += length
                yield settled()
        encoder.settle()
        packer.finish()
        yield settled()

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def op6_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE = None
