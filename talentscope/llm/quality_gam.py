"""Quality classifier: generalised additive model with pairwise interactions.

Numeric features of a whole text are cut into quantile bins. Training boosts
shallow trees in cyclic order, one feature at a time with a small step, so each
feature ends as one lookup table of additive scores per bin; then the pairs with
the strongest remaining signal get two-dimensional tables the same way. Scoring
is a sum of table entries, for a block of rows at once.

The model is fitted on the driver on at most ``MAX_ROWS`` labelled rows (those
with the smallest id hashes); every document is scored on its whole text.

Defined cases: a NULL text scores like an empty one; label rows with NULL id or
label are ignored; several labels of a document count by majority, a tie as 1;
without labelled rows every score is 0.5, with one class only it is that class's
rate (smoothed); repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from talentscope.llm.arrow_rows import map_texts
from talentscope.llm.common import crc_mod
from talentscope.llm.html_extract import STOP_WORDS

MAX_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
PAIR_ROUNDS = 60
STEP = 0.15
SHRINK = 5.0                # added to each leaf's curvature
FEATURES = (
    "words", "word_length", "distinct", "distinct_pairs", "same_as_previous", "stop_words",
    "upper", "digits", "punctuation", "symbols", "shouts", "bars", "wide", "line_words",
    "repeated_lines", "spaces")

_GROUPS = np.zeros(256, dtype=np.int64)          # byte -> group of characters
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()?-",
                             "#*$%&<>@^~=+_/\\{}[]", "!", "|", " \t\n\r\v\f"), start=1):
    for _c in _chars:
        _GROUPS[ord(_c)] = _i
_GROUPS[128:192] = 8                             # continuation bytes: no character of their own
_GROUPS[192:] = 9                                # first bytes of wide characters


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for a whole text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    count = np.bincount(_GROUPS, weights=by_byte, minlength=10)
    chars = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    ahead = words[1:]
    return [
        float(n), sum(map(len, words)) / n, len(set(words)) / n,
        len(set(zip(words, ahead))) / max(1, n - 1),
        sum(map(str.__eq__, words, ahead)) / n, sum(map(STOP_WORDS.__contains__, words)) / n,
        count[1] / chars, count[2] / chars, count[3] / chars, count[4] / chars, count[5] / chars,
        count[6] / chars, count[9] / chars, n / len(lines), 1 - len(set(lines)) / len(lines),
        count[7] / chars,
    ]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))




def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree with up to four leaves on binned gradients."""
    out = np.zeros(len(g))
    todo = [(0, len(g))]
    for _ in range(2):
        parts = []
        for lo, hi in todo:
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            if hi - lo < 2:
                parts.append((lo, hi))
                continue
            lg, lh, tg, th = cg[:-1], ch[:-1], cg[-1], ch[-1]
            gain = lg ** 2 / (lh + SHRINK) + (tg - lg) ** 2 / (th - lh + SHRINK)
            k = int(np.argmax(gain))
            if gain[k] <= tg ** 2 / (th + SHRINK) + 1e-9:
                parts.append((lo, hi))
            else:
                parts += [(lo, lo + k + 1), (lo + k + 1, hi)]
        todo = parts
    for lo, hi in todo:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + SHRINK)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, value per cell) of the best pair of cuts of a gradient grid."""
    def four(m):
        c = m.cumsum(0).cumsum(1)
        ll = c[:-1, :-1]
        lt, tl = c[:-1, -1:], c[-1:, :-1]
        return ll, lt - ll, tl - ll, c[-1, -1] - lt - tl + ll
    gs, hs = four(g), four(h)
    gain = sum(a ** 2 / (b + SHRINK) for a, b in zip(gs, hs))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [a[i, j] / (b[i, j] + SHRINK) for a, b in zip(gs, hs)]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:] = v[0], v[1]
    out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v[2], v[3]
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + SHRINK)), out


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], 1)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Lookup tables from feature rows ``x`` and 0/1 labels ``y``."""
    if not len(y):
        return {"base": 0.0, "edges": [], "tables": [], "pairs": []}
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return {"base": base, "edges": [], "tables": [], "pairs": []}
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], q)) for f in range(x.shape[1])]
    b = _bins(x, edges)
    tables = [np.zeros(len(e) + 1) for e in edges]
    score = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f, t in enumerate(tables):
            p = _sigmoid(score)
            step = STEP * _tree(np.bincount(b[:, f], y - p, len(t)),
                                np.bincount(b[:, f], p * (1 - p), len(t)))
            t += step
            score += step[b[:, f]]
    coarse = [np.arange(len(t)) * PAIR_BINS // len(t) for t in tables]
    cb = np.stack([c[b[:, f]] for f, c in enumerate(coarse)], 1)
    cells = PAIR_BINS * PAIR_BINS

    def grid(f, g_, p):
        at = cb[:, f] * PAIR_BINS + cb[:, g_]
        return (np.bincount(at, y - p, cells).reshape(PAIR_BINS, PAIR_BINS),
                np.bincount(at, p * (1 - p), cells).reshape(PAIR_BINS, PAIR_BINS), at)
    p = _sigmoid(score)
    gains = {(f, g): _quadrants(*grid(f, g, p)[:2])[0]
             for f, g in itertools.combinations(range(len(tables)), 2)}
    best = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    pairs = {k: np.zeros((PAIR_BINS, PAIR_BINS)) for k in best}
    for _ in range(PAIR_ROUNDS):
        for (f, g), t in pairs.items():
            gg, hh, at = grid(f, g, _sigmoid(score))
            step = STEP * _quadrants(gg, hh)[1]
            t += step
            score += step.ravel()[at]
    return {"base": base, "edges": edges, "tables": tables,
            "pairs": [(f, g, coarse[f], coarse[g], t) for (f, g), t in pairs.items()]}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: the sum of table entries per row."""
    total = np.full(len(x), model["base"])
    if model["edges"]:
        b = _bins(x, model["edges"])
        for f, t in enumerate(model["tables"]):
            total += t[b[:, f]]
        for f, g, cf, cg, t in model["pairs"]:
            total += t[cf[b[:, f]], cg[b[:, g]]]
    return _sigmoid(total)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          max_rows: int = MAX_ROWS) -> dict:
    """Fits the model on the documents whose crc32(doc_id) mod 4 is not 2."""
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()
                           & (crc_mod(F.col("doc_id"), 4) != 2))
             .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        return lambda ts: {"x": pa.array([features(t) for t in ts], pa.list_(pa.float64()))}
    rows = (map_texts(texts, ["doc_id", "y"], "text",
                      StructType([StructField("x", ArrayType(DoubleType(), False))]), make)
            .orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).collect())
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows]))


def score_documents(docs: DataFrame, model: dict, keys: list[str],
                    text: str = "text") -> DataFrame:
    """``keys`` of every document with its ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def fn(ts):
            return {"score": score(shared.value, np.array([features(t) for t in ts]))}
        return fn
    return map_texts(docs, keys, text, StructType([StructField("score", DoubleType())]), make)
