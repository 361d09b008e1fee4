"""Language identification: sparse multinomial logistic regression on TF-IDF
weights of character n-grams.

Texts are lower-cased, runs of other characters than letters become one space,
and all n-grams of 1 to 3 characters are hashed into ``BUCKETS``. Document
frequencies cover every document that may be learned from. The weights are
trained by follow-the-regularised-leader with an elastic net on a sample of at
most ``MAX_ROWS`` documents, spread over the languages; a fifth of the sample
then sets the temperature of the scores. Predictions read whole texts.
Every language is learned; the driver holds a table of ``BUCKETS`` x languages.

Defined cases: a NULL text or one without a letter is ``und`` with score 0;
rows with NULL language teach nothing; without any language to learn every text
is ``und``; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType,
                               StructField, StructType)

from talentscope.llm.arrow_rows import map_texts, slices
from talentscope.llm.common import crc_mod

BUCKETS = 1 << 15
MAX_ROWS = 2400
LEAST_ROWS = 6               # documents of a language in the sample, however many there are
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
UNDECIDED = "und"

_letters: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[points]


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - 15)).astype(np.int64)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a text's n-grams; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _is_letter(points)
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]                      # of each gap, its first character stays
    c = np.where(letter, points, 32)[keep].astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c]) if c[0] != 32 else c
    one = c[c != 32]
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] << np.uint64(21) | c[2:]
    tag = np.uint64(1) << np.uint64(63)
    h = np.concatenate([_hash(one), _hash(two ^ (tag >> np.uint64(1))), _hash(three ^ tag)])
    n = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def weighted(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of unit length for (buckets, counts)."""
    v = (1 + np.log(counts[1])) * idf[counts[0]]
    return v / max(1e-12, float(np.sqrt(v @ v)))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """(documents per bucket, documents) over all of ``docs``. Every task sends one
    partial count per bucket; ``BUCKETS`` sums reach the driver."""
    def run(batches):
        df, n = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s, e in slices(texts):
                for t in texts[s:e]:
                    got = ngram_counts(t)
                    if got is not None:
                        df[got[0]] += 1
                        n += 1
        if n:
            df[BUCKETS] = n
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])],
                                             names=["bucket", "n"])
    parts = docs.select(text).mapInArrow(run, StructType([
        StructField("bucket", IntegerType()), StructField("n", LongType())]))
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out[:BUCKETS], int(out[BUCKETS])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (BUCKETS + 1 bias, classes) by per-coordinate FTRL-proximal steps."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros_like(z)

    def weights(zz, nn):
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)
    for _ in range(EPOCHS):
        for at, v, k in rows:
            at, v = np.append(at, BUCKETS), np.append(v, 0.1)
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            p = _softmax(v @ w)
            p[k] -= 1
            g = v[:, None] * p[None, :]
            after = nn + g * g
            z[at] = zz + g - (np.sqrt(after) - np.sqrt(nn)) / ALPHA * w
            n[at] = after
    return weights(z, n)


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss on held-back rows."""
    if not len(truth):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 80))
    loss = [-np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(truth)), truth])).mean()
            for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> dict | None:
    """Model from text and language of the documents whose crc32(doc_id) mod 3 is
    not 1 (a NULL id may be learned from); None if there is nothing to learn."""
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    pool = docs.select("doc_id", "text", "lang").filter(
        ~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = pool.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return None
    df, n = document_frequencies(pool)
    idf = np.log((1 + n) / (1 + df)) + 1
    share = max(LEAST_ROWS, max_rows / len(counts))
    span = 1 << 20
    limit = F.create_map(*[x for r in counts for x in (
        F.lit(r["lang"]), F.lit(int(min(1.0, share / r["count"]) * span)))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    chosen = pool.filter(draw < F.try_element_at(limit, F.col("lang")))

    def make():
        def fn(ts):
            got = [ngram_counts(t) or (np.zeros(0, int), np.zeros(0)) for t in ts]
            return {"at": pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())),
                    "n": pa.array([c.astype(np.float32) for _, c in got], pa.list_(pa.float32()))}
        return fn
    sample = map_texts(chosen, ["doc_id", "lang"], "text", StructType([
        StructField("at", ArrayType(IntegerType(), False)),
        StructField("n", ArrayType(FloatType(), False))]), make)
    rows = sample.orderBy(F.xxhash64("doc_id", "lang"), "at", "n").limit(int(2 * share * len(counts))).toArrow()
    names = sorted(r["lang"] for r in counts)
    number = {k: i for i, k in enumerate(names)}
    data = []
    for i in range(rows.num_rows):
        at = rows["at"][i].values.to_numpy(zero_copy_only=False)
        if len(at):
            c = (at, rows["n"][i].values.to_numpy(zero_copy_only=False))
            data.append((at, weighted(c, idf), number[rows["lang"][i].as_py()]))
    held_back = data[::5]
    w = ftrl([d for i, d in enumerate(data) if i % 5] or data, len(names))
    logits = np.array([np.append(v, 0.1) @ w[np.append(at, BUCKETS)] for at, v, _ in held_back])
    t = _temperature(logits, np.array([k for _, _, k in held_back], dtype=int))
    return {"names": names, "idf": idf, "weights": (w / t).astype(np.float32)}


def predict(docs: DataFrame, model: dict | None, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` of every document with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def one(t):
            got = ngram_counts(t) if m else None
            if got is None:
                return UNDECIDED, 0.0
            p = _softmax(weighted(got, m["idf"]) @ m["weights"][got[0]] + 0.1 * m["weights"][BUCKETS])
            k = int(np.argmax(p))
            return m["names"][k], float(min(1.0, p[k]))

        def fn(ts):
            got = [one(t) for t in ts]
            return {"lang_pred": [a for a, _ in got], "score": [b for _, b in got]}
        return fn
    return map_texts(docs, keys, text, StructType([
        StructField("lang_pred", StringType()), StructField("score", DoubleType())]), make)
