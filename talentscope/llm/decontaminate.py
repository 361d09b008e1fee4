"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items build one automaton; every document's
words are streamed through it while the length of the longest match ending at
each word is tracked. A match of ``window`` words or more puts its last
``window`` words inside a benchmark window; an item shorter than the window is
one window of its own. Stretches that hold no pair of adjacent benchmark words
cannot match and are skipped before streaming.

The benchmark reaches the driver in blocks of at most about ``BLOCK_BYTES``;
every block has its own automaton (broadcast, so its size is bounded by the
block), and the documents pass through the blocks one after the other. Long
items are cut into overlapping pieces that together hold every window.

Defined cases: a NULL or wordless text has no hit; items without words have no
window; items with equal ids count once; a NULL item id marks words but counts
as no item; repeated documents are judged alike; an empty benchmark hits
nothing; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from talentscope.llm.arrow_rows import map_texts, slices
from talentscope.llm.common import named, staged

WINDOW = 10
BLOCK_BYTES = 2 << 20
#: A document whose share of hit words is larger is dropped whole.
MAX_COVERAGE = 0.5
PAIR_BITS = 20

_OTHER = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_FOLD = bytes(32 if c in _OTHER else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over item words, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws])
                 for i, ws in items if ws]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: per state: the suffix-link ancestor that holds the last ``window`` words
        self.holder = [0] * len(self.link)
        for v in order:
            up = self.link[v]
            self.holder[v] = v if self.length[up] < window else self.holder[up]
        self.items: dict[int, set] = {}
        own: dict[int, set] = {}
        for item, seq in coded:
            state = 0
            for k, w in enumerate(seq):
                state = self.next[state][w]
                if k + 1 >= window:
                    self.items.setdefault(self.holder[state], set()).add(item)
            if len(seq) < window:
                own.setdefault(state, set()).add((len(seq), item))
        #: per state: (length, item) of the short items that end there
        self.short: dict[int, tuple] = {}
        for v in order:
            got = own.get(v, set()) | set(self.short.get(self.link[v], ()))
            if got:
                self.short[v] = tuple(got)
        self.least = min([len(s) for _, s in coded] + [window])
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        for _, seq in coded:
            a = np.array(seq, dtype=np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    @staticmethod
    def _pair(a, b):
        return ((a * 2654435761 + b * 40503) >> 3) & ((1 << PAIR_BITS) - 1)

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) word ranges in which all words and neighbours are known
        to the benchmark and a window has room."""
        if len(ids) == 0 or not self.vocab:
            return []
        known = ids >= 0
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        joined[at] = self.pairs[self._pair(ids[at], ids[at + 1])]
        breaks = np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(ids)]])
        long = (np.diff(breaks) >= self.least) & known[breaks[:-1]]
        return list(zip(breaks[:-1][long].tolist(), breaks[1:][long].tolist()))

    def hits(self, seq: list[int], offset: int, spans: list, found: set) -> None:
        """Streams ``seq``; appends hit [start, end) ranges and the items met."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for i, w in enumerate(seq):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            if size >= window:
                found |= self.items[self.holder[state]]
                spans.append((offset + i + 1 - window, offset + i + 1))
            for n, item in self.short.get(state, ()):
                if n <= size:
                    found.add(item)
                    spans.append((offset + i + 1 - n, offset + i + 1))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def scan(automaton: Automaton, texts: list[str | None]) -> list[tuple[int, list, set]]:
    """(words, merged hit ranges, item ids) of each text."""
    get = automaton.vocab.get
    sizes, ids = [], []
    for t in texts:
        ws = words_of(t)
        sizes.append(len(ws))
        ids += [get(w, -1) for w in ws]
        ids.append(-1)
    flat = np.array(ids, dtype=np.int64)
    ends = np.cumsum(np.array(sizes, dtype=np.int64) + 1)
    starts = np.concatenate([[0], ends])[:-1]
    spans: list[list] = [[] for _ in texts]
    found: list[set] = [set() for _ in texts]
    for s, e in automaton.stretches(flat):
        d = int(np.searchsorted(ends, s, side="right"))
        automaton.hits(ids[s:e], s - int(starts[d]), spans[d], found[d])
    return [(n, merged(sp), f) for n, sp, f in zip(sizes, spans, found)]


def _blocks(bench: DataFrame, window: int) -> list[list[tuple[str | None, str]]]:
    """The benchmark's (item id, text piece) rows, one bounded block at a time."""
    rows = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(
        "text is not null")
    step = BLOCK_BYTES // 4

    def cut(batches):
        for batch in batches:
            ids, texts = [], []
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(t) <= step:
                    ids.append(item)
                    texts.append(t)
                    continue
                ws = words_of(t)
                at = 0
                while True:
                    end, size = at, 0
                    while end < len(ws) and (size < step or end - at < 2 * window):
                        size += len(ws[end]) + 1
                        end += 1
                    ids.append(item)
                    texts.append(b" ".join(ws[at:end]).decode())
                    if end == len(ws):
                        break
                    at = end - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()),
                                              pa.array(texts, pa.string())],
                                             names=["item_id", "text"])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = rows if size <= BLOCK_BYTES else staged(
        rows.mapInArrow(cut, rows.schema), "benchmark")
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        part = pieces if n == 1 else pieces.filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def contamination(docs: DataFrame, bench: DataFrame, keys: list[str], text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """``keys`` and ``text`` of every document with ``n_words``, ``spans`` (merged
    hit ranges of word numbers, flat: start, end, start, end ...) and ``items``
    (sorted distinct ids of the items whose windows occur)."""
    sc = docs.sparkSession.sparkContext
    out = docs.select(*map(named, keys), named(text).alias("__body"))
    schema = StructType([StructField("n_words", LongType()),
                         StructField("spans", ArrayType(IntegerType(), False)),
                         StructField("items", ArrayType(StringType(), False))])
    for b, rows in enumerate(_blocks(bench, window)):
        auto = sc.broadcast(Automaton([(i, words_of(t)) for i, t in rows], window))

        def make(auto=auto):
            def fn(texts):
                got = scan(auto.value, texts)
                return {
                    "n_words": pa.array([n for n, _, _ in got], pa.int64()),
                    "spans": pa.array([[x for s in sp for x in s] for _, sp, _ in got],
                                      pa.list_(pa.int32())),
                    "items": pa.array([sorted(f - {None}) for _, _, f in got],
                                      pa.list_(pa.string()))}
            return fn
        if b == 0:
            out = map_texts(out, [*keys, "__body"], "__body", schema, make)
            continue
        prior = out.select(*keys, "__body", F.struct("spans", "items").alias("__prior"))
        out = map_texts(prior, [*keys, "__body", "__prior"], "__body", schema, make)
        out = staged(out.select(
            *keys, "__body", "n_words",
            F.concat("__prior.spans", "spans").alias("spans"),
            F.array_sort(F.array_union("__prior.items", "items")).alias("items")), "contamination")
    return out.withColumnRenamed("__body", text) if text not in keys else out.drop("__body")


def hit_words(spans: list[int]) -> int:
    """Words covered by flat ranges that may overlap."""
    return sum(e - s for s, e in merged(list(zip(spans[::2], spans[1::2]))))


def digests(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    schema = StructType(found.select(*keys).schema.fields + [
        StructField("n_words", LongType()), StructField("n_hit", LongType()),
        StructField("n_items", LongType()), StructField("items_sha256", StringType())])

    def run(batches):
        for batch in batches:
            n = len(keys)
            spans, items = batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n + 1)]
                + [pa.array([hit_words(s) for s in spans], pa.int64()),
                   pa.array([len(x) for x in items], pa.int64()),
                   pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items])],
                names=schema.names)
    return (found.select(*keys, "n_words", "spans", "items").mapInArrow(run, schema)
            .withColumn("contaminated", F.col("n_hit") > 0))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given word ranges and the separators inside them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    keep, pos = [], 0
    for s, e in spans:
        keep.append(raw[pos:at[s][0]])
        pos = at[e - 1][1]
    return b"".join([*keep, raw[pos:]]).decode()


def _clean(automaton: Automaton, texts: list[str | None]) -> list[tuple[str | None, int, int]]:
    """(text without hits, words before, words cut) of each text; a window that a
    cut joins anew is cut as well."""
    out = [(t, n, sum(e - s for s, e in spans), spans)
           for t, (n, spans, _) in zip(texts, scan(automaton, texts))]
    done = [(t, n, gone) for t, n, gone, _ in out]
    todo = [i for i, x in enumerate(out) if x[3]]
    spans = {i: out[i][3] for i in todo}
    while todo:
        cut = [cut_words(done[i][0], spans[i]) for i in todo]
        again = scan(automaton, cut)
        for i, t, (_, sp, _) in zip(todo, cut, again):
            done[i] = (t, done[i][1], done[i][2] + sum(e - s for s, e in sp))
            spans[i] = sp
        todo = [i for i in todo if spans[i]]
    return done


def _marked(automaton: Automaton, texts: list[str | None], marks: list[list[int]],
            last: bool) -> list[tuple[str | None, int, int, list[int]]]:
    """(text, words, words cut, flat merged hit ranges) of each text, with the ranges
    ``marks`` that other blocks found; the text is cut if this is the ``last`` block."""
    out = []
    for t, prior, (n, spans, _) in zip(texts, marks, scan(automaton, texts)):
        spans = merged([*zip(prior[::2], prior[1::2]), *spans])
        cut = last and bool(spans)
        out.append((cut_words(t, spans) if cut else t, n,
                    sum(e - s for s, e in spans) if cut else 0, [x for s in spans for x in s]))
    return out


def remove_contamination(docs: DataFrame, bench: DataFrame, text: str = "text",
                         n_chars: str = "n_chars", window: int = WINDOW,
                         max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Documents without their hit spans, with the columns of ``docs``. A document
    whose hit words exceed ``max_coverage`` of its words is dropped; ``n_chars``,
    where present, is set anew for cut texts. With several benchmark blocks every
    block marks the same uncut text, the union is cut after the last one, and the
    texts that were cut go through all blocks again until none of them hits."""
    sc = docs.sparkSession.sparkContext
    rest = [c for c in docs.columns if c != text]
    state = docs.select(F.struct(*map(named, rest)).alias("o"), named(text).alias("t"),
                        F.lit(-1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("gone"),
                        F.array().cast("array<int>").alias("spans"))
    schema = state.schema

    def one_pass(df, step):
        def run(batches):
            for batch in batches:
                texts, marks = batch.column(1).to_pylist(), batch.column(4).to_pylist()
                for s, e in slices(texts):
                    part = batch.slice(s, e - s)
                    got = step(texts[s:e], marks[s:e])
                    n = [m if m >= 0 else g[1] for m, g in zip(part.column(2).to_pylist(), got)]
                    gone = [x + g[2] for x, g in zip(part.column(3).to_pylist(), got)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([g[0] for g in got], pa.string()),
                         pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                         pa.array([g[3] for g in got], pa.list_(pa.int32()))], names=schema.names)
        return df.mapInArrow(run, schema)

    def whole(auto):
        return lambda texts, _: [(*g, []) for g in _clean(auto.value, texts)]

    def block(auto, last):
        return lambda texts, marks: _marked(auto.value, texts, marks, last)

    autos = [sc.broadcast(Automaton([(i, words_of(t)) for i, t in rows], window))
             for rows in _blocks(bench, window)]
    if len(autos) == 1:
        state = one_pass(state, whole(autos[0]))
    else:
        done = []
        while not done or not state.isEmpty():
            for i, auto in enumerate(autos):
                state = staged(one_pass(state, block(auto, i + 1 == len(autos))), "cleaned")
            done.append(state.filter(F.size("spans") == 0))
            state = state.filter(F.size("spans") > 0).withColumn("spans", F.array().cast("array<int>"))
        state = reduce(DataFrame.union, done)
    kept = state.filter(F.col("gone") <= max_coverage * F.col("n"))
    cols = [F.col("t").alias(text) if c == text
            else F.when(F.col("gone") > 0, F.length("t")).otherwise(F.col("o").getField(c)).cast(
                docs.schema[c].dataType).alias(c) if c == n_chars
            else F.col("o").getField(c).alias(c) for c in docs.columns]
    return kept.select(*cols)
