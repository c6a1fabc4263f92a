"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts elsewhere. The kernel
(``repeated_starts``) takes a shard of segments, sorts its suffixes, and derives common prefixes
from the transform: breadth-first, each interval of suffixes with a common prefix of l bytes is extended backward by every
byte that precedes it, and an interval of length l + 1 found that way ends with a common
prefix of l, so values come in increasing order. Expansion stops at the threshold; suffixes that share
with a neighbour a prefix that was never assigned are repeats.

Shards hold only what can repeat. Every window of ``LENGTH`` bytes names its anchor: the place of the least hash among the
``ANCHOR``-byte strings in it. Equal windows have equal anchors, so a window can repeat only if its anchor's
hash occurs twice in the corpus. Windows in a row that share an anchor form a segment, and segments go to shards
by the anchor's hash, equal ones as one row with a count. An anchor in very many places is dealt finer: by ``BLOCK``
windows, keyed by the bytes that all of them have. Copies of a whole text count once with a multiplicity. No
candidate is dropped; hashes only deal out, the transform decides wherever a key has a segment that occurs once beside others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 200
ANCHOR = 64
#: Anchors in more places than this are dealt by blocks of windows.
HOT = 512
BLOCK = 8
PIECE = 1 << 20
SHARD_BYTES = 1 << 20
#: Segments settled without a transform that are given out at once.
SETTLED_ROWS = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE_BITS = 21


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = _power(base, max(n, 1 << 16))
    return _powers[base][:n]


_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(b: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each place on."""
    base = int(_BASE)
    up, down = _powers_of(base, len(b)), _powers_of(pow(base, -1, 1 << 64), len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up, dtype=np.uint64)])
    h = (total[n:] - total[:-n]) * down[: len(b) - n + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(b: np.ndarray, length: int = LENGTH, gram: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows, offset of the anchor in the first window) of the runs of windows with one anchor, for up to 2**21 bytes."""
    h = _gram_hashes(b, gram)
    width = length - gram + 1
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    place = (key & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    at = place[first]
    return h[at].view(np.int64), first, np.diff(first, append=len(place)), at - first


# -- the kernel ---------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (symbols below 512)."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    heads = np.flatnonzero(fresh)
    rank[order] = np.repeat(heads, np.diff(heads, append=n))
    known = 7
    while known < depth:
        tied = ~(fresh & np.concatenate([fresh[1:], [True]]))
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        at = order[rows]
        both = (rank[at] << 32) | (rank[np.minimum(at + known, n)] + 1)
        sort = np.argsort(both, kind="stable")
        order[rows] = at[sort]
        both = both[sort]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        fresh[rows] = new
        heads = np.flatnonzero(new)
        rank[order[rows]] = np.repeat(rows[heads], np.diff(heads, append=len(rows)))
        known *= 2
    return order


def repeated_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` symbols (below 511) from each place on also start elsewhere."""
    text = np.concatenate([text + np.uint16(1), np.zeros(1, np.uint16)])  # an end that is least and unique, so that every prefix of every suffix ends somewhere
    n = len(text)
    order = suffix_order(text, length + 1)
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    before = np.concatenate([text[-1:], text[:-1]]).astype(np.int64)[order]  # the transform, with the end before the start
    back = row_of[np.where(order == 0, n - 1, order - 1)]  # row of the suffix one symbol longer
    unset = np.ones(n + 1, bool)
    unset[n] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(length):  # values 0, 1, ... length - 1
        size = high - low
        total = int(size.sum())
        offset = np.cumsum(size) - size
        rows = np.arange(total) + np.repeat(low - offset, size)
        key = np.repeat(np.arange(len(low)), size) * 512 + before[rows]
        to = back[rows]
        sort = np.argsort(key, kind="stable")
        key, to = key[sort], to[sort]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        new_low = np.minimum.reduceat(to, head)
        new_high = new_low + np.diff(head, append=len(to))
        fresh = unset[new_high]
        low, high = new_low[fresh], new_high[fresh]
        unset[high] = False
        if not len(low):
            break
    shared = np.concatenate([[False], unset[1:n], [False]])
    out = np.empty(n, bool)
    out[order] = shared[:-1] | shared[1:]
    return out[:-1]


def repeated_starts(segments: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment: whether the ``length`` bytes from each place on start elsewhere in the shard, or the segment itself has a count above 1."""
    text = np.zeros(sum(map(len, segments)) + len(segments), np.uint16)
    at, edges = 0, []
    for x in segments:
        text[at : at + len(x)] = np.frombuffer(x, np.uint8)
        text[at : at + len(x)] += 1
        edges.append(at)
        at += len(x) + 1
    found = repeated_suffixes(text, length)
    return [found[a : a + len(x) - length + 1] | (n > 1) for a, x, n in zip(edges, segments, counts, strict=True)]


# -- over the corpus ----------------------------------------------------------------------------


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _digest(data: bytes) -> bytes:
    """Names a text: 96 bits, so that two texts of even 10**11 share one with a chance below 10**-6."""
    return hashlib.blake2b(data, digest_size=12).digest()


def _pieces(n: int, length: int):
    """(from, to) of pieces whose windows of ``length`` bytes, taken together, are those of n bytes, each once."""
    for at in range(0, n - length + 1, PIECE):
        yield at, min(n, at + PIECE + length - 1)


#: A run of windows as one number: first window, number of windows, offset of the anchor (10 bits each of the latter).
_BITS = 10
_ROWS = "doc_id long, digest binary, n_bytes long, sha string, hashes array<long>, windows array<long>"


def _scan(length: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _encoded(text)
                found = []
                for a, b in _pieces(len(data), length):
                    h, first, count, offset = anchors(np.frombuffer(data[a:b], np.uint8), length)
                    found.append((h, (first + a) << 2 * _BITS | count << _BITS | offset))
                parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 2)]
                row = (doc_id, _digest(data), len(data), hashlib.sha256(data).hexdigest(), *parts)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in _ROWS.split(", ")])

    return run


def _segments(length: int):
    """Segments of the anchors that occur twice: (digest, first, key, seg_hash, segment)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            held = 0
            for text, digest, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = _encoded(text)
                if _digest(data) != digest:
                    continue  # another text under the same id
                for x in listed:
                    h, places, low = x["h"], x["places"], (1 << _BITS) - 1
                    first, runs, offset = x["windows"] >> 2 * _BITS, x["windows"] >> _BITS & low, x["windows"] & low
                    if places <= HOT:
                        cut = [(h, first, runs)]
                    else:
                        cut = []
                        last = first + runs
                        # blocks are counted from the anchor, so that equal windows fall in like blocks
                        start = first
                        while start < last:
                            block = (offset - (start - first)) // BLOCK
                            stop = min(last, start + (offset - (start - first)) % BLOCK + 1)
                            lo, hi = first + offset - (block * BLOCK + BLOCK - 1), first + offset - block * BLOCK
                            core = data[hi : lo + length]
                            key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=block.to_bytes(2, "big"), key=h.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)
                            cut.append((key, start, stop - start))
                            start = stop
                    for key, start, n in cut:
                        segment = data[start : start + n + length - 1]
                        for column, value in zip(out, (digest, start, key, hashlib.blake2b(segment, digest_size=12).digest(), segment), strict=True):
                            column.append(value)
                        held += len(segment)
                if held > 4 << 20:
                    yield _batch(out)
                    out, held = [[] for _ in range(5)], 0
            yield _batch(out)

    def _batch(out):
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["digest", "first", "key", "seg_hash", "segment"])

    return run


def _shards(length: int):
    """(key, seg_hash, segment, n), sorted by key, to the runs of repeated starts of each segment.

    Windows that share an anchor are equal only at the same offset from it, so none is equal to another of its own segment: a key
    with one distinct segment, or whose segments all have a count above 1, is settled by the counts and needs no transform.
    """

    def run(batches):
        group, shard, settled = [], [], []
        size = 0

        def close():
            nonlocal size
            if len(group) > 1 and any(n == 1 for *_, n in group):
                shard.extend(group)
                size += sum(len(segment) for _, _, segment, _ in group)
            else:
                settled.extend((key, seg_hash, len(segment) - length + 1) for key, seg_hash, segment, n in group if n > 1)
            group.clear()

        def flush():
            nonlocal size
            starts = repeated_starts([x[2] for x in shard], np.array([x[3] for x in shard]), length) if shard else []
            long = np.array([len(x) for x in starts], np.int64) + 1
            begin = np.cumsum(long) - long
            marks = np.zeros(int(long.sum()) + 1, np.int8)  # a gap after each segment, so that no run crosses
            for at, x in zip(begin.tolist(), starts, strict=True):
                marks[at : at + len(x)] = x
            edge = np.flatnonzero(np.diff(marks, prepend=np.int8(0)))
            at, runs = edge[::2], edge[1::2] - edge[::2]
            own = np.searchsorted(begin, at, "right") - 1
            named, first = np.unique(own, return_index=True)
            whole = np.array([x[2] for x in settled], np.int64)
            lists = np.concatenate([first, len(at) + np.arange(len(whole) + 1)])
            at = np.concatenate([at - begin[own], np.zeros(len(whole), np.int64)])
            runs = np.concatenate([runs, whole])
            rows = [shard[i] for i in named.tolist()] + settled
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in rows], pa.int64()),
                    pa.array([x[1] for x in rows], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(at, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(runs, pa.int32())),
                ],
                ["key", "seg_hash", "at", "runs"],
            )
            shard.clear()
            settled.clear()
            size = 0
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    close()
                    if size > SHARD_BYTES or len(settled) > SETTLED_ROWS:
                        yield flush()
                group.append(row)
        close()
        if shard or settled:
            yield flush()

    return run


def _cut(length: int):
    """Texts with their repeated starts to what is left of them."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text, digest, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = _encoded(text)
                if _digest(data) != digest:
                    continue
                gone = np.zeros(len(data) + 1, np.int32)
                for r in ranges:
                    at = r["first"] + np.array(r["at"], np.int64)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + np.array(r["runs"], np.int64) + length - 1, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                for column, value in zip(out, (doc_id, digest, len(data), int(gone.sum()), spans, kept), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "digest", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


_NO_ID = -(1 << 63)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of (doc_id, text), texts as UTF-8.

    A null text is empty; texts shorter than ``length`` keep all. Matches stay within a text on either side. Repeated rows
    count as copies: each loses all its bytes if it has ``length`` of them. Rows may share an id or have none. No rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, _ = common.store(docs.mapInArrow(_scan(length), _ROWS), "anchors")
    texts = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("rep"), F.first(F.struct("hashes", "windows")).alias("x"))
    places = texts.select("digest", F.explode(F.arrays_zip(F.col("x.hashes").alias("h"), F.col("x.windows").alias("windows"))).alias("a")).select("digest", "a.*")
    twice = places.groupBy("h").agg(F.count("*").alias("places")).where(F.col("places") > 1)
    found = places.join(twice, "h").groupBy("digest").agg(F.collect_list(F.struct("h", "windows", "places")).alias("listed")).join(texts.select("digest", "rep"), "digest")
    keyed = docs.withColumn("rep", F.coalesce("doc_id", F.lit(_NO_ID))).select("rep", "text")
    segments = keyed.join(found, "rep").select("text", "digest", "listed").mapInArrow(_segments(length), "digest binary, first long, key long, seg_hash binary, segment binary")
    segments, _ = common.store(segments, "segments")
    shards = segments.groupBy("key", "seg_hash", "segment").agg(F.count("*").alias("n"))
    shards = shards.repartition(common.shuffle_partitions(spark), "key").sortWithinPartitions("key")
    starts = shards.mapInArrow(_shards(length), "key long, seg_hash binary, at array<int>, runs array<int>")
    ranges = segments.select("digest", "first", "key", "seg_hash").join(starts, ["key", "seg_hash"]).groupBy("digest").agg(F.collect_list(F.struct("first", "at", "runs")).alias("ranges"))
    single = texts.where(F.col("copies") == 1).select("digest", "rep")
    cut = keyed.join(single.join(ranges, "digest"), "rep").select(F.col("rep").alias("doc_id"), "text", "digest", "ranges")
    cut = cut.mapInArrow(_cut(length), "doc_id long, digest binary, n_bytes long, n_removed long, n_spans long, kept binary")
    cut = cut.select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    copies = texts.where(F.col("copies") > 1).select("digest", F.lit(True).alias("copied"))
    whole = rows.select("doc_id", "digest", "n_bytes", "sha").join(copies, "digest", "left").join(cut, "digest", "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    return whole.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))


ORACLE = None
