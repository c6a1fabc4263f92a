"""Language identification by error-correcting output codes.

Every learned language has a codeword. For each bit of it a binary classifier over
hashed byte trigrams (naive Bayes log odds of the languages whose bit is 1 against
the others) gives a margin. Loss-weighted decoding takes the codeword with the smallest
sum of logistic losses, each weighted by how often that classifier was right for that
language in training, and flags a text as ambiguous if the second best is close.

Training reads a sample of at most about ``SAMPLE_PER_LANG`` distinct labelled texts a language, chosen by a
hash of the text; the model is K codewords and a table of 65,537 x bits weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FEATURES = 1 << 16
SAMPLE_PER_LANG = 2000
AMBIGUOUS_BELOW = 0.1
PIECE = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # langs x bits, -1 or 1
    weights: np.ndarray  # (FEATURES + 1) x bits; the last row is zero
    trust: np.ndarray  # langs x bits; rows sum to 1


def codewords(k: int) -> np.ndarray:
    """The exhaustive code up to six languages, above that a fixed pseudo-random one of about 10 log2(k) bits."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 6:
        columns = np.arange((1 << (k - 1)) - 1)
        bits = np.vstack([np.ones_like(columns), *[(columns >> j) & 1 for j in range(k - 1)]])
    else:
        rng = np.random.default_rng(k)
        bits = rng.integers(0, 2, (k, math.ceil(10 * math.log2(k))))
        while len(np.unique(bits, axis=0)) < k or (bits.min(0) == bits.max(0)).any():
            bits = rng.integers(0, 2, bits.shape)
    return (2 * bits - 1).astype(np.int8)


def features(data: bytes) -> np.ndarray:
    """Hashed trigrams of the bytes, one for each place; two at the end count as none."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.full(len(b), FEATURES, np.int32)
    if len(b) > 2:
        out[:-2] = ((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean log odds of each bit. Long texts go through in pieces that overlap by two bytes."""
    out = np.zeros((len(texts), weights.shape[1]))
    if not texts:
        return out
    datas = [_bytes(x) for x in texts]
    at = 0
    while at < len(datas):
        if len(datas[at]) > PIECE:
            whole = datas[at]
            for i in range(0, len(whole), PIECE):
                out[at] += weights[features(whole[i : i + PIECE + 2])].sum(0, dtype=np.float64)
            at += 1
            continue
        to, size = at, 0
        while to < len(datas) and size + len(datas[to]) <= PIECE:
            size += len(datas[to])
            to += 1
        lengths = np.fromiter(map(len, datas[at:to]), np.int64, to - at)
        own = np.flatnonzero(lengths)
        if len(own):
            ends = np.cumsum(lengths)
            ix = features(b"".join(datas[at:to]))
            for back in (1, 2):  # trigrams that reach into the next text
                ix[np.maximum(ends[own] - back, 0)] = FEATURES
            out[at + own] = np.add.reduceat(weights[ix], (ends - lengths)[own], axis=0)
        at = to
    n = np.fromiter((max(1, len(x) - 2) for x in datas), np.float64, len(datas))
    return out / n[:, None]


#: Steepness of the logistic loss for a mean log odds.
STEEP = 6.0


def decode(margin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, score, ambiguous) by loss-weighted decoding."""
    loss = np.logaddexp(0, -STEEP * margin[:, None, :] * model.code[None])
    total = (loss * model.trust[None]).sum(2)
    best = total.argmin(1)
    likely = np.exp(-(total - total.min(1, keepdims=True)) * 4)
    likely /= likely.sum(1, keepdims=True)
    score = likely[np.arange(len(best)), best]
    second = np.partition(likely, -2, axis=1)[:, -2] if likely.shape[1] > 1 else np.zeros(len(best))
    return best, score, score - second < AMBIGUOUS_BELOW


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            count = total.setdefault(lang, np.zeros(FEATURES + 1, np.int64))
            data = _bytes(text)
            for i in range(0, len(data), PIECE):
                count += np.bincount(features(data[i : i + PIECE + 2]), minlength=FEATURES + 1)
    for lang, count in total.items():
        at = np.flatnonzero(count[:FEATURES])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(count[at], pa.int64())], ["lang", "feature", "n"])


def train(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on (text, lang) rows; those with a null text or lang are left out. No rows give a model that knows no language."""
    rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # distinct texts count, so that copies don't thin out the sample
    distinct = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    code = codewords(len(langs))
    if not langs:
        return Model([], code, np.zeros((FEATURES + 1, 1), np.float32), np.ones((0, 1)))
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, per_lang / sizes[x]))])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(1 << 30) * share[F.col("lang")]).distinct()
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), FEATURES))
    found = sample.mapInArrow(_counts, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts[[at[x] for x in found.column("lang").to_pylist()], found.column("feature").to_numpy()] = found.column("n").to_numpy()
    share_of = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    weights = np.zeros((FEATURES + 1, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        ones, zeros = share_of[code[:, b] > 0], share_of[code[:, b] < 0]
        if len(ones) and len(zeros):
            weights[:FEATURES, b] = np.log(ones.mean(0)) - np.log(zeros.mean(0))
    model = Model(langs, code, weights, np.full(code.shape, 1 / code.shape[1]))

    def right(batches):
        good, seen = np.zeros(code.shape), np.zeros(len(langs))
        for batch in batches:
            lang = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
            if len(lang):
                np.add.at(good, lang, margins(batch.column("text").to_pylist(), weights) * code[lang] > 0)
                np.add.at(seen, lang, 1)
        i = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(seen[i]), pa.array(list(good[i]), pa.list_(pa.float64()))], ["lang", "seen", "good"])

    good, seen = np.zeros(code.shape), np.zeros(len(langs))
    bits = [F.sum(F.element_at("good", b + 1)).alias(f"b{b}") for b in range(code.shape[1])]
    for r in sample.mapInArrow(right, "lang long, seen double, good array<double>").groupBy("lang").agg(F.sum("seen").alias("seen"), *bits).collect():
        seen[r["lang"]], good[r["lang"]] = r["seen"], r[2:]
    trust = (good + 1) / (seen[:, None] + 2)
    model.trust = trust / trust.sum(1, keepdims=True)
    return model


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, then lang_pred, score and ambiguous.

    A null text, one without a letter, or a model without languages gives ``und``, 0
    and false. Every row gives one, repeated ones included; the whole text counts.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in added)])

    def run(batches):
        model = held.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            pred, score, unsure = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            own = [i for i, x in enumerate(texts) if model.langs and has_letter(x)]
            if own:
                best, score[own], unsure[own] = decode(margins([texts[i] for i in own], model.weights), model)
                pred[own] = np.array(model.langs, object)[best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], [*keep, *(n for n, _ in added)])
        common.hand_back()

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id")))
    out = identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


ORACLE = None
