"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints that differ in at most d bits agree in at least m - d of m blocks. Each distinct fingerprint is
listed under every choice of m - d blocks, rows that share a listing are compared by Hamming
distance, and links give components. m is the smallest number for which a listing has so many bits that by chance
at most ``2 ** BY_CHANCE`` fingerprints share one, so listings stay short as the table grows.

Fingerprints may have several words of 64 bits. Near copies by the usual measure (four fifths of the shingles in
common) differ in about a seventh of the bits, which no choice of blocks of 64 bits can list; with four words each
fingerprint is listed under single blocks, of the bits as they are and of the bits in fixed permuted orders. Pairs that differ in fewer
bits than one order has blocks are then found for certain, others with the chance that some block agrees. There are as many
orders as bring that chance to ``FOUND`` at the largest distance that links, so it does not fall as the table grows.

A listing that many fingerprints share (near copies agree in most blocks) is dealt to tasks by chunks of
its members, one of which meets all others, then, where that leaves members in different components, by the pairs of chunks that may still link. A task returns, instead of all links that its listings give, one spanning forest of
them, which has the same components: its rows grow with the members of a group, not with their pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components, spanning, thinned

SEED = 42
DISTANCE = 3
#: Members of a chunk of a long listing.
CHUNK = 2048
#: Chance that a pair at the largest distance is found, where that is too large for certainty.
FOUND = 0.99
#: Least bits that a listing compares, and the power of two of the members that it may have by chance.
LEAST_BITS, BY_CHANCE = 14, 8
#: Listings up to this length are compared all at once.
SHORT = 64
PIECE_SHINGLES = 1 << 16
#: Similarity from which sets link, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Words of the fingerprint that proposes, most bits that may differ, and the bits at which a pair is listed with chance ``FOUND``.
#: At similarity 0.8 about 39 of 256 bits differ, with a deviation of 6; in the shortest texts 48.
PROPOSE_WORDS, PROPOSE_WITHIN, PROPOSE_AT = 4, 64, 48
#: Sets of a chunk of a large group of proposed links.
CHUNK_SETS = 512
#: Bits of the map of rows in proposals: 16 MB at every table size. Rows that it lets through by chance go in the exact join.
MAP_BITS = 1 << 27


def _digests(text: str | None, shingle: int):
    """Hashes of the shingles of words, A-Z in lower case, in order and in pieces; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - shingle + 1)
    lows, highs = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE_SHINGLES):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(lows[at : at + PIECE_SHINGLES], highs[at : at + PIECE_SHINGLES], strict=True)], "<u8")


def _majority(pieces, words_out: int) -> np.ndarray:
    ones, n = np.zeros(64 * words_out, np.int64), 0
    for part in pieces:
        n += len(part)
        if words_out > 1:
            part = np.stack([part, *(_remix(part, k) for k in range(1, words_out))], axis=1)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8 * words_out), axis=1, bitorder="little")
        for i in range(0, len(bits), 4096):  # sums of short runs in small numbers are quick
            ones += bits[i : i + 4096].sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = 3, words_out: int = 1) -> np.ndarray:
    """SimHash (``words_out`` numbers of 64 bits) over shingles of words; repeats count, no words give 0."""
    return _majority(_digests(text, shingle), words_out)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *_digests(text, shingle)]))


def _unit(members: np.ndarray) -> int:
    """Number of a shingle set, as a signed long."""
    return _signed(xxhash.xxh3_64_intdigest(members.tobytes()))


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """The columns ``keep`` and ``fp`` (``words`` signed longs) of each row."""

    def run(batches):
        for batch in batches:
            fp = [fingerprint(x, shingle, words).view(np.int64) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.list_(pa.int64()))], [*keep, "fp"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.ArrayType(T.LongType()))])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def block_choices(n: int, distance: int = DISTANCE, words: int = 1) -> list[tuple[int, ...]]:
    """Masks (one for each word) of the listings: the bits that must agree, as many as n fingerprints need."""
    need = max(LEAST_BITS, max(1, n).bit_length() - BY_CHANCE)
    if words > 1:
        bits, size = 64 * words, need
        agree = (1 - distance / bits) ** size
        listings = math.ceil(math.log(1 - FOUND) / math.log(1 - agree))
        order, found = np.arange(bits), []
        rng = np.random.default_rng(SEED)
        while len(found) < max(listings, bits // size):
            for at in range(0, bits - size + 1, size):
                mask = [0] * words
                for i in order[at : at + size].tolist():
                    mask[i // 64] |= 1 << i % 64
                found.append(tuple(mask))
            order = rng.permutation(bits)
        return found[: max(listings, bits // size)]
    for m in range(distance + 1, 17):
        edges = [64 * i // m for i in range(m + 1)]
        block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        masks = [sum(c) for c in itertools.combinations(block, m - distance)]
        if min(x.bit_count() for x in masks) >= need:
            break
    return [(x,) for x in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def _forest(fps: np.ndarray, reps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members of one listing."""
    label = np.arange(len(fps))
    out = []
    for i in range(len(fps) - 1):
        apart = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        near = apart[_differ(fps[apart], fps[i]) <= distance]
        others, first = np.unique(label[near], return_index=True)
        for other, j in zip(others.tolist(), near[first].tolist(), strict=True):
            label[label == other] = label[i]
            out.append((int(reps[i]), int(reps[j])))
    return out


def _pairs_of(batches, distance: int):
    """Links within runs of one listing key, at most one a row; rows come sorted by it."""
    held: list[np.ndarray] = []

    def links(key, fps, reps):
        a, b = [], []
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(edge, append=len(key))
        run = np.repeat(edge + size, size)
        for step in range(1, int(size[size <= SHORT].max(initial=1))):  # short listings: neighbours at each distance, all at once
            i = np.flatnonzero((np.arange(len(key)) + step < run) & (np.repeat(size, size) <= SHORT))
            i = i[_differ(fps[i], fps[i + step]) <= distance]
            a.append(reps[i])
            b.append(reps[i + step])
        for at, n in zip(edge[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            found = np.array(_forest(fps[at : at + n], reps[at : at + n], distance), np.int64).reshape(-1, 2)
            a.append(found[:, 0])
            b.append(found[:, 1])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if len(a) > len(key):
            at = spanning(a, b)
            a, b = a[at], b[at]
        return a, b

    for batch in batches:
        if not batch.num_rows:
            continue
        task, *words, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        now = [task, np.stack(words, axis=1).view(np.uint64), rep]
        held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        if len(held[0]) and held[0][0] != held[0][-1]:
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield links(held[0][:cut], held[1][:cut], held[2][:cut])
            held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield links(*held)
    held.clear()
    common.hand_back()


def _by_task(dealt: DataFrame) -> DataFrame:
    return dealt.repartition(common.shuffle_partitions(dealt.sparkSession), "task").sortWithinPartitions("task")


def _links(listed: DataFrame, columns: list[str], chunk: int, find, counted: DataFrame, rows_of) -> DataFrame:
    """Links (a, b) that ``find`` gives for rows (task, columns) sorted by task, with the components of all rows of ``listed`` that share a key.

    ``counted`` has (key, rep) of ``listed``. Keys with over ``chunk`` rows go to tasks by chunks, the first of which meets all others. Only rows that these
    links leave in different components still have to meet: components of over ``chunk`` rows keep chunks of their own, which do not meet each other, the others are
    pooled in chunks, and all other pairs of chunks are tasks. ``rows_of`` gives the columns of the rows whose reps are in a table.
    """

    def found(dealt):
        return _by_task(dealt).mapInArrow(lambda batches: thinned(find(batches)), "a long, b long")

    # read from a table, so that its size is known when the join is planned
    sizes = counted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    long, _ = common.store(sizes.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), "long-listings")
    if long.isEmpty():
        return found(listed.select(F.col("key").alias("task"), *columns))
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int")
    tasks = F.when(F.col("parts").isNull(), F.array("key")).when(own > 0, F.array(F.xxhash64("key", own)))
    tasks = tasks.otherwise(F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.xxhash64("key", i)))
    met, _ = common.store(found(listed.join(long, "key", "left").select(F.explode(tasks).alias("task"), *columns)), "met")
    label = components(met).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    members = counted.select("key", "rep").join(long.select("key"), "key").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    members, _ = common.store(members, "long-members")
    own = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    apart = own.groupBy("key").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("n") <= chunk, F.col("n"))).alias("pooled")).where(F.col("labels") > 1)
    own, _ = common.store(own.join(apart.select("key", F.ceil(F.col("pooled") / chunk).alias("pools")), "key"), "long-labels")
    if own.isEmpty():
        return met
    large = F.col("n") > chunk
    # a chunk's number, and its component if that has chunks of its own
    of_part = lambda i: F.struct(F.when(large, F.xxhash64("key", "label", i)).otherwise(F.xxhash64("key", i)).alias("chunk"), F.when(large, F.col("label")).alias("alone"))
    parts = F.when(large, F.ceil(F.col("n") / chunk)).otherwise(F.col("pools"))
    chunks = own.select("key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), of_part)).alias("x")).select("key", "x.*").distinct()
    placed = members.join(own, ["key", "label"]).select("key", "rep", of_part(F.pmod(F.xxhash64("rep", F.lit(11)), parts)).alias("x")).select("key", "rep", "x.*")
    pairs = placed.join(chunks.select("key", F.col("chunk").alias("other"), F.col("alone").alias("others")), "key")
    pairs = pairs.where(F.col("alone").isNull() | F.col("others").isNull() | (F.col("alone") != F.col("others")))
    pairs = pairs.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("task"), "rep")
    pairs, _ = common.store(pairs, "long-pairs")
    return met.unionByName(found(rows_of(pairs.select("rep").distinct()).join(pairs, "rep").select("task", *columns)))


def near_links(reps: DataFrame, distance: int = DISTANCE, words: int = 1, listed_at: int | None = None) -> DataFrame:
    """(fp, rep) with unique reps to links (a, b) between reps whose components are those of all pairs within the distance.

    With several words, the blocks are as many as find a pair at ``listed_at`` bits (the distance, if not given) with chance ``FOUND``.
    """
    names = [f"word{w}" for w in range(words)]
    keys = [
        F.xxhash64(F.lit(i), *(F.col(name).bitwiseAND(F.lit(_signed(m))) for name, m in zip(names, mask, strict=True) if m))
        for i, mask in enumerate(block_choices(reps.count(), listed_at or distance, words))
    ]
    rows = reps.select(*(F.element_at("fp", w + 1).alias(name) for w, name in enumerate(names)), "rep")
    listed = rows.select(*names, "rep", F.explode(F.array(*keys)).alias("key"))
    return _links(listed, [*names, "rep"], CHUNK, lambda batches: _pairs_of(batches, distance), listed, lambda need: rows)


def _similar(sets: list[np.ndarray], reps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose similarity (common by all members) is ``SIMILAR`` or more."""
    top, bottom = SIMILAR
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    edge = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(ids, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=1))])
    label = np.arange(len(sets))
    out = []
    for i in range(len(sets) - 1):
        may = (label != label[i]) & (bottom * np.minimum(size, size[i]) >= top * np.maximum(size, size[i]))
        may[: i + 1] = False
        if not may.any():
            continue
        common_ = np.zeros(len(sets), np.int64)
        for at in range(edge[i], edge[i + 1], 4096):
            mine = ids[at : min(at + 4096, edge[i + 1])]
            n = first[mine + 1] - first[mine]
            common_ += np.bincount(holders[np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        near = np.flatnonzero(may & (bottom * common_ >= top * (size + size[i] - common_)))
        others, at = np.unique(label[near], return_index=True)
        for other, j in zip(others.tolist(), near[at].tolist(), strict=True):
            label[label == other] = label[i]
            out.append((int(reps[i]), int(reps[j])))
    return out


def _similar_of(batches):
    """Links of similar sets within runs of one task; rows come sorted by it."""
    task, sets, reps = None, [], []

    def links():
        once = dict(zip(reps, sets, strict=True))
        found = _similar(list(once.values()), np.array(list(once), np.int64)) if len(once) > 1 else []
        found = np.array(found, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    for batch in batches:
        for now, rep, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != task:
                yield links()
                task, sets, reps = now, [], []
            sets.append(np.frombuffer(members, "<u8"))
            reps.append(rep)
    yield links()
    sets.clear()
    common.hand_back()


def _row_map(rows: DataFrame):
    """A broadcast map of ``MAP_BITS`` bits in which those of the rows' numbers are set."""
    place = F.pmod(F.col("row"), F.lit(MAP_BITS)) + 1
    parts = rows.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    held = np.zeros(MAP_BITS // 8, np.uint8)
    found = parts.toArrow()
    for bucket, bits in zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist(), strict=True):
        held[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(held)


def _units(docs: DataFrame, keep: list[str], added: dict[str, T.DataType], of_text, only=None) -> DataFrame:
    """The columns ``keep`` and those that ``of_text`` gives for each text; with a map ``only`` of the rows whose number, the first column, may be in it."""

    def run(batches):
        for batch in batches:
            if only is not None:
                place = batch.column(0).to_numpy(zero_copy_only=False) & (MAP_BITS - 1)
                batch = batch.filter(pa.array((only.value[place >> 3] >> (place & 7) & 1).astype(bool)))
            rows = [of_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*keep, *added])
        common.hand_back()

    kinds = [{"fp": pa.list_(pa.int64()), "rep": pa.int64(), "members": pa.binary()}[n] for n in added]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in added.items())])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def first_of_near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, row, text), with a number ``row`` that differs for different rows, to (doc_id, row, copies) of the row with the least (doc_id, row) in each
    group of near copies, with the number of its exact repeats. Rows with a null doc_id link others but are never the first.

    SimHash blocks over distinct shingles only propose: the components of proposed links are compared by their exact sets, all pairs, and
    those with a similarity of ``SIMILAR`` or more link.
    """

    def print_of(text):
        members = shingle_set(text, shingle)
        pieces = (members[at : at + PIECE_SHINGLES] for at in range(0, len(members), PIECE_SHINGLES))
        return _majority(pieces, PROPOSE_WORDS).view(np.int64), _unit(members)

    def set_of(text):
        members = shingle_set(text, shingle)
        return _unit(members), members.tobytes()

    prints, _ = common.store(_units(docs, ["doc_id", "row"], {"fp": T.ArrayType(T.LongType()), "rep": T.LongType()}, print_of), "prints")
    by_row = prints.groupBy("rep", "doc_id", "row").agg(F.first("fp").alias("fp"), F.count("*").alias("copies"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row", "copies"))
    reps, _ = common.store(by_row.groupBy("rep").agg(F.first("fp").alias("fp"), F.min(named).alias("name"), F.min("row").alias("row")), "reps")
    proposed, _ = common.store(components(near_links(reps.select("fp", "rep"), PROPOSE_WITHIN, PROPOSE_WORDS, PROPOSE_AT)), "proposed")
    ours, _ = common.store(proposed.join(reps, proposed["node"] == reps["rep"]).select(F.col("component").alias("key"), "row", "rep"), "proposed-rows")

    def sets_of(rows):  # sets are taken only of rows in proposals, before the join, so that no texts are shuffled
        return _units(docs, ["row"], {"rep": T.LongType(), "members": T.BinaryType()}, set_of, _row_map(rows)).join(rows.drop("rep"), "row")

    links = _links(sets_of(ours), ["rep", "members"], CHUNK_SETS, _similar_of, ours, lambda need: sets_of(ours.join(need, "rep", "left_semi").select("row", "rep")))
    found = components(links)
    joined = reps.join(found, reps["rep"] == found["node"], "left").select("name", F.coalesce("component", "rep").alias("root"))
    return joined.groupBy("root").agg(F.min("name").alias("name")).where(F.col("name").isNotNull()).select("name.*")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = DISTANCE, words: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of (doc_id, text).

    The fingerprint is 16 lowercase hex digits a word; component_id is the smallest doc_id that links lead to, the own one included. A null
    text has no words; texts without words have fingerprint zero and are linked like others. Repeated rows
    each give one. Rows with a null doc_id link as others do but lend no name; a component of such rows only has a null component_id.
    """
    prints, _ = common.store(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "text", shingle, words), "prints")
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("name"))
    # fingerprints are linked by numbers of their own, so that rows without an id can link too
    rep = F.element_at("fp", 1) if words == 1 else F.xxhash64("fp")
    reps, _ = common.store(lowest.select("fp", "name", rep.alias("rep")), "reps")
    found = components(near_links(reps.select("fp", "rep"), distance, words))
    joined = reps.join(found, reps["rep"] == found["node"], "left").select("fp", "name", F.coalesce("component", "rep").alias("root"))
    least = joined.groupBy("root").agg(F.min("name").alias("component_id"))
    of_print = joined.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.array_join(F.transform("fp", lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "").alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = None
