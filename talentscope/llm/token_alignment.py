"""Alignment of two tokenizers over a corpus: which ids stand for the same bytes.

A text is encoded by a byte-level BPE (A, with a space put before it) and by a
SentencePiece model (B, which puts that space itself). Where tokens of both end at
the same byte, a group ends; two tokens are linked when their byte ranges overlap.
How many documents hold a pair of ids linked is counted over the whole corpus:

* pairs of an A id with *its* B id of the same bytes (an array computed once from
  the vocabularies; one-to-one groups give nothing else) are counted in arrays as
  long as A's vocabulary, one per task, summed by id;
* all other pairs, from irregular groups, are pre-aggregated in their task and
  summed by a shuffle on the pair.

Counts go back to the documents from arrays too: A's vocabulary length for the
first kind, the most frequent of the others up to ``MAX_PAIRS``; rarer pairs are
joined by the pair. The texts are encoded once; what the later passes read is
written to the shared folder.

Defined cases: a NULL or empty text, and one whose joined A or B bytes are not those
of space + text (a text with U+2581), has no tokens and an empty digest; repeated
rows are documents of their own; ids may have any type, NULL included; further
columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StringType, StructField,
                               StructType)

from talentscope.llm.arrow_rows import map_texts
from talentscope.llm.common import staged

#: Frequent irregular pairs whose counts are broadcast at most (12 bytes each).
MAX_PAIRS = 1 << 20
#: Pair occurrences that a task collects before it merges them, and distinct pairs
#: beyond which it hands them on.
GATHERED, DISTINCT = 1 << 22, 1 << 21
#: Split of a text into words by which byte-level BPE vocabularies of this kind are made.
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACE = "▁"
#: Distinct words that a task remembers at most.
REMEMBERED_WORDS = 200_000
#: Words encoded in one call.
JOINED = 64
_GAP = re.compile(r"(?<=\S) (?=\S)")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes, in order, for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Encoder of a byte-level BPE file whose merges are listed in id order."""

    def __init__(self, file: bytes):
        import tiktoken

        spec = json.loads(file)
        alphabet = _byte_of_char()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        made = [vocab[a + b] for a, b in merges]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or spec.get(
                "normalizer") or made != sorted(made) or len(vocab) != 256 + len(made):
            raise ValueError("a byte-level BPE file with merges in id order is needed")
        self.surface = [b""] * (max(spec["model"]["vocab"].values(), default=0) + 1)
        for t, i in vocab.items():
            self.surface[i] = bytes(map(alphabet.__getitem__, t))
        self._bpe = tiktoken.Encoding("a", pat_str=WORD_PATTERN, special_tokens={}, mergeable_ranks={
            self.surface[i]: i for i in vocab.values()})

    def encode(self, text: str) -> list[int]:
        return self._bpe.encode_ordinary(text)


class PieceBpe:
    """Encoder of a SentencePiece model with byte pieces."""

    def __init__(self, file: bytes):
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = self._sp.get_piece_size()
        pieces = [self._sp.id_to_piece(i) for i in range(n)]
        self.is_byte = [self._sp.is_byte(i) for i in range(n)]
        self.surface = [bytes([int(p[3:5], 16)]) if b else p.replace(SPACE, " ").encode()
                        for p, b in zip(pieces, self.is_byte)]
        #: no piece goes on behind a space, and white space is kept as it is
        self.by_words = (not any(SPACE in p.lstrip(SPACE) for p in pieces)
                         and self._sp.encode(" a  b ") == self._sp.encode(" a  b ".replace(" ", SPACE)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._sp.encode(texts, num_threads=1)


class Aligner:
    """Tokens, groups and links of texts; vocabulary tables of both tokenizers.

    A single space between two characters that are no white space starts a token in
    both tokenizers, so a text falls into words that are aligned each on its own and
    remembered (``REMEMBERED_WORDS`` at most); a text's results are joined from them."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.a, self.b = ByteBpe(a_file), PieceBpe(b_file)
        self.n_a, self.n_b = len(self.a.surface), len(self.b.surface)
        self.a_size, self.b_size = (np.array([len(s) for s in x.surface]) for x in (self.a, self.b))
        same = {s: i for i, s in enumerate(self.b.surface) if self.b.is_byte[i]}
        same |= {s: i for i, s in enumerate(self.b.surface) if not self.b.is_byte[i]}
        #: A id -> B id of the same bytes (a piece before a byte piece), -1 for none
        self.same = np.array([same.get(s, -1) if s else -1 for s in self.a.surface])
        self.a_text, self.b_text = (
            np.array([[f"{i}{sep}" for i in range(n)] for sep in seps], dtype=object)
            for n, seps in ((self.n_a, ",|"), (self.n_b, ",;")))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        #: of each word: A tokens, B tokens, groups, links
        self.sizes = np.zeros((4, 0), dtype=np.int64)
        self.groups: list[str] = []
        self.bad: set[int] = set()
        self.ends, self.pairs = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _words(self, text: str) -> list[str]:
        if not self.b.by_words:
            return [text]
        words = text.split(" ")
        return words if "" not in words and list(map(str.strip, words)) == words else _GAP.split(text)

    def _tokens(self, words: list[str]):
        """Words in a new order, which of them their tokens spell, their bytes, and
        the A and B ids of those in a row. Words are encoded many at a time, joined by
        spaces; one by one where the tokens are not the joined text."""
        joins = [w for w in words if self.b.by_words and w == w.strip()]
        alone = set(words) - set(joins)
        todo = [joins[i:i + JOINED] for i in range(0, len(joins), JOINED)] + [[w] for w in alone]
        order, spelt, a, b = [], [], [], []
        while todo:
            again = []
            for ws, ids in zip(todo, self.b.encode([" ".join(ws) for ws in todo])):
                whole = " " + " ".join(ws)
                at, raw = self.a.encode(whole), whole.encode()
                ok = (b"".join(map(self.b.surface.__getitem__, ids)) == raw
                      == b"".join(map(self.a.surface.__getitem__, at)))
                if not ok and len(ws) > 1:
                    again += [[w] for w in ws]
                    continue
                order += ws
                spelt += [ok] * len(ws)
                if ok:
                    a += at
                    b += ids
            todo = again
        sizes = np.fromiter(map(len, map(str.encode, order)), np.int64, len(order)) + 1
        spelt = np.array(spelt, dtype=bool)
        return order, spelt, np.where(spelt, sizes, 0), np.array(a, np.int64), np.array(b, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Aligns new words; those that their tokens do not spell are ``bad``."""
        words, spelt, sizes, a, b = self._tokens(words)
        word_end = np.cumsum(sizes)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # each stretch between two neighbouring ends is one overlap of one A and one B token
        ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        twice = ends[1:] == ends[:-1]
        cuts, ends = ends[1:][twice], ends[np.concatenate([[True], ~twice])[:len(ends)]]
        pairs = a[np.searchsorted(a_end, ends)] * self.n_b + b[np.searchsorted(b_end, ends)]
        na, nb, n_groups, n_links = (np.diff(np.searchsorted(x, word_end, side="right"), prepend=0)
                                     for x in (a_end, b_end, cuts, ends))
        first = len(self.groups)
        self.bad.update((np.flatnonzero(~spelt) + first).tolist())
        self.known.update(zip(words, range(first, first + len(words))))
        self.groups += self._spelling(a, b, a_end, b_end, cuts, na, nb)
        self.sizes = np.concatenate([self.sizes, [na, nb, n_groups, n_links]], axis=1)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n_links)])
        self.pairs = np.concatenate([self.pairs, pairs])

    def _spelling(self, a, b, a_end, b_end, cuts, na, nb) -> list[str]:
        """Each word's groups: ``a1,a2|b1;a3|b2,b3``."""
        ga, gb = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        before_a = np.concatenate([[0], np.searchsorted(a_end, cuts, side="right")])
        before_b = np.concatenate([[0], np.searchsorted(b_end, cuts, side="right")])
        out = np.empty(len(a) + len(b), dtype=object)
        if len(cuts):
            out[np.arange(len(a)) + before_b[ga]] = self.a_text[(a_end == cuts[ga]).astype(int), a]
            out[np.arange(len(b)) + before_a[gb + 1]] = self.b_text[(b_end == cuts[gb]).astype(int), b]
        out = out.tolist()
        at = np.concatenate([[0], np.cumsum(na + nb)]).tolist()
        return ["".join(out[s:e])[:-1] for s, e in zip(at[:-1], at[1:])]

    def align(self, texts: list[str | None]) -> dict:
        """Columns of ``ALIGNED`` for the texts."""
        if len(self.known) > REMEMBERED_WORDS:
            self._forget()
        split = [self._words(t) if t else [] for t in texts]
        fresh = set().union(*split) - self.known.keys()
        if fresh:
            self._learn(list(fresh))
        flat = list(map(self.known.__getitem__, chain.from_iterable(split)))
        sizes = np.array([len(ws) for ws in split], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        digests, spelt = [], np.ones(len(texts), dtype=bool)
        for i, (s, e) in enumerate(zip(at[:-1], at[1:])):
            ws = flat[s:e]
            spelt[i] = not self.bad or self.bad.isdisjoint(ws)
            groups = ";".join(map(self.groups.__getitem__, ws)) if spelt[i] else ""
            digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        doc = np.repeat(np.arange(len(texts)), sizes)
        word = np.array(flat, dtype=np.int64)[spelt[doc]]
        doc, ends = doc[spelt[doc]], np.cumsum(np.where(spelt, sizes, 0))
        sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(self.sizes[:, word], axis=1)], axis=1)
        sums = np.diff(sums[:, np.concatenate([[0], ends])], axis=1)
        # distinct words of each document, then the distinct pairs of those
        key, times = _counted(doc * max(1, len(self.groups)) + word)
        doc, word = np.divmod(key, max(1, len(self.groups)))
        n = self.ends[word + 1] - self.ends[word]
        at = np.repeat(self.ends[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, times = _counted(np.repeat(doc, n) << 40 | self.pairs[at], np.repeat(times, n))
        doc, pair = key >> 40, key & ((1 << 40) - 1)
        a_id, b_id = np.divmod(pair, self.n_b)
        regular = self.same[a_id] == b_id

        def lists(values, use, kind):
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[use], minlength=len(texts)))])
            return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                            pa.array(values[use].astype(kind)))
        return dict(zip(COUNTS, map(pa.array, sums))) | {
            "groups_sha256": digests,
            "same_ids": lists(a_id, regular, np.int32), "same_times": lists(times, regular, np.int32),
            "pairs": lists(pair, ~regular, np.int64), "pair_times": lists(times, ~regular, np.int32),
        }


def _counted(key: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sum of their ``times`` (1 each if not given)."""
    if times is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    if times is None:
        return key[starts], np.diff(np.concatenate([starts, [len(key)]]))
    return key[starts], np.add.reduceat(times, starts) if len(key) else times


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = StructType([
    *(StructField(c, LongType()) for c in COUNTS), StructField("groups_sha256", StringType()),
    StructField("same_ids", ArrayType(IntegerType(), False)),
    StructField("same_times", ArrayType(IntegerType(), False)),
    StructField("pairs", ArrayType(LongType(), False)),
    StructField("pair_times", ArrayType(IntegerType(), False))])


@lru_cache(maxsize=1)
def _aligner(a_file: bytes, b_file: bytes) -> Aligner:
    return Aligner(a_file, b_file)


def _files(docs: DataFrame, a_path: str, b_path: str):
    """Both vocabulary files, read on the driver: executors need no copy of them."""
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    return files, docs.sparkSession.sparkContext.broadcast(files)


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Per row: ``id``, the columns of ``ALIGNED`` and a number ``row`` of its own."""
    _, shared = _files(docs, a_path, b_path)

    def make():
        return _aligner(*shared.value).align
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    return staged(map_texts(src, ["id"], "t", ALIGNED, make).withColumn(
        "row", F.monotonically_increasing_id()), "aligned")


def same_id_counts(rows: DataFrame, n_a: int) -> np.ndarray:
    """Documents that hold each A id linked with its B id of the same bytes."""
    def run(batches):
        seen = np.zeros(n_a, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_a)
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[ids])], names=["a", "c"])
    out = np.zeros(n_a, dtype=np.int64)
    sums = rows.select("same_ids").mapInArrow(run, "a long, c long").groupBy("a").agg(F.sum("c"))
    for a, c in sums.collect():                     # one row per id of the vocabulary at most
        out[a] = c
    return out


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, b, c): documents that hold each irregular pair linked."""
    def run(batches):
        key, count, fresh, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            k, at = np.unique(np.concatenate([key, *fresh]), return_inverse=True)
            c = np.bincount(at[len(key):], minlength=len(k))
            c[at[:len(key)]] += count
            return k, c

        def out(k, c):
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["pair", "c"])
        for batch in batches:
            fresh.append(batch.column(0).flatten().to_numpy())
            held += len(fresh[-1])
            if held > GATHERED:
                key, count = merged()
                fresh, held = [], 0
                if len(key) > DISTINCT:
                    yield out(key, count)
                    key, count = key[:0], count[:0]
        yield out(*merged())
    sums = rows.select("pairs").mapInArrow(run, "pair long, c long").groupBy("pair").agg(
        F.sum("c").alias("c"))
    return staged(sums.select("pair", F.floor(F.col("pair") / n_b).cast("int").alias("a"),
                              F.pmod("pair", F.lit(n_b)).cast("int").alias("b"), "c"), "pairs")


def _frequent(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(pairs ascending, their counts, least count): the most frequent ones, as many
    whole classes of counts as ``MAX_PAIRS`` allows."""
    level = F.floor(F.log2("c") * 4).cast("int")
    left, lowest = MAX_PAIRS, None
    for r in sorted(pairs.groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.min("c").alias("c"))
                    .collect(), key=lambda r: -r["l"]):
        left -= r["n"]
        if left < 0:
            break
        lowest = r["c"]
    if lowest is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), NONE
    got = pairs.filter(F.col("c") >= lowest).select("pair", "c").toArrow()
    pair, c = (got.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(pair)
    return pair[order], c[order], lowest


NONE = np.iinfo(np.int64).max


def _sums(values: np.ndarray, offsets) -> np.ndarray:
    offsets = np.asarray(offsets, dtype=np.int64) - offsets[0].as_py()
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def alignment(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id",
              text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). Documents: ``doc_id``, the counts, ``groups_sha256``,
    ``n_best`` (links whose pair has the highest count of its A id) and ``count_sum``
    (the pair's count, summed over links). Pairs: a, b, c of every pair linked."""
    spark = docs.sparkSession
    files, _ = _files(docs, a_path, b_path)
    tables = _aligner(*files)
    n_a, n_b, same = tables.n_a, tables.n_b, tables.same
    rows = aligned(docs, a_path, b_path, doc_id, text)
    regular = same_id_counts(rows, n_a)
    pairs = pair_counts(rows, n_b)
    best = regular.copy()
    for a, c in pairs.groupBy("a").agg(F.max("c")).collect():
        best[a] = max(best[a], c)
    shared = spark.sparkContext.broadcast((regular, best, *_frequent(pairs)))
    lowest = shared.value[-1]

    def run(batches):
        regular, best, known, known_count, _ = shared.value
        for batch in batches:
            ids, times, pair, pair_times = (batch.column(i) for i in range(n_own, n_own + 4))
            a, t = ids.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            n_best = _sums(t * (regular[a] == best[a]), ids.offsets)
            total = _sums(t * regular[a], ids.offsets)
            key, t = pair.flatten().to_numpy(), pair_times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            hit = known[at] == key if len(known) else np.zeros(len(key), dtype=bool)
            c = np.where(hit, known_count[at], 0) if len(known) else np.zeros(len(key), np.int64)
            n_best += _sums(t * (hit & (c == best[key // n_b])), pair.offsets)
            total += _sums(t * c, pair.offsets)
            rest = pa.array(np.concatenate([[0], np.cumsum(_sums((~hit).astype(np.int64), pair.offsets))])
                            .astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n_own)), pa.array(n_best), pa.array(total),
                 pa.ListArray.from_arrays(rest, pa.array(key[~hit])),
                 pa.ListArray.from_arrays(rest, pa.array(t[~hit]))], names=schema.names)

    own = ["row", "id", *COUNTS, "groups_sha256"]
    n_own = len(own)
    schema = StructType(rows.select(*own).schema.fields + [
        StructField("n_best", LongType()), StructField("count_sum", LongType()),
        StructField("open", ArrayType(LongType(), False)),
        StructField("open_times", ArrayType(LongType(), False))])
    part = staged(rows.select(*own, "same_ids", "same_times", "pairs", "pair_times")
                  .mapInArrow(run, schema), "counted")
    # pairs too rare for the broadcast: each is held by few documents
    bests = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)],
                                  "a int, best long")
    rare = pairs.filter(F.col("c") < lowest).join(bests, "a").select(
        "pair", "c", (F.col("c") == F.col("best")).alias("is_best"))
    found = (part.select("row", F.explode(F.arrays_zip("open", "open_times")).alias("o"))
             .select("row", F.col("o.open").alias("pair"), F.col("o.open_times").alias("times"))
             .join(rare, "pair").groupBy("row")
             .agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"),
                  F.sum(F.col("times") * F.col("c")).alias("more_sum")))
    out = part.join(found, "row", "left").select(
        F.col("id").alias(doc_id), *COUNTS,
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
    used = np.flatnonzero(regular)
    one_to_one = spark.createDataFrame(
        [(int(a), int(same[a]), int(regular[a])) for a in used], "a int, b int, c long")
    return out, pairs.select("a", "b", "c").unionByName(one_to_one)
