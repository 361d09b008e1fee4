"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The vocabulary file is read once on the driver (its size bounds what is
broadcast); tasks hold it as flat tables. A text becomes one flat array of
symbols over all its distinct words; every round finds each word's best ranked
pair (a segmented minimum), merges its leftmost occurrence in all words at once,
and compacts, until no pair is left. A piece that no better piece can grow out
of is merged at all its (leftmost, non-overlapping) places in one round: its
order against the others cannot matter. Words are told apart by 64-bit hashes.
A long word (a text without spaces, a blob) merges many ranks in one round: every
pair that is better than all pairs so near that a piece could reach from them to it.

Defined cases: a NULL text encodes like an empty one (no ids); characters
outside the vocabulary become byte pieces; repeated rows are encoded alike;
other columns are ignored by the digests and kept by ``encode``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StringType, StructField,
                               StructType)

from talentscope.llm.arrow_rows import map_texts
from talentscope.llm.common import named
from talentscope.llm.hashing import Spans, mix

SPACE = "▁"
NEVER = np.iinfo(np.int64).max
#: Distinct words whose ids a task remembers at most.
REMEMBERED_WORDS = 200_000
#: Symbols from which a word counts as long.
LONG_WORD = 256


def load_vocabulary(path: str) -> dict:
    """Plain tables of a BPE model file with byte pieces and identity normaliser."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i)
             else "unknown" if sp.is_unknown(i) else "normal" for i in range(n)]
    if kinds.count("byte") != 256:
        raise ValueError("a model with byte pieces is needed")
    if sp.encode(" a  b ") != sp.encode(" a  b ".replace(" ", SPACE)):
        raise ValueError("a model that keeps white space as it is is needed")
    return {"pieces": [sp.id_to_piece(i) for i in range(n)], "kinds": kinds,
            "scores": [sp.get_score(i) for i in range(n)]}


class Bpe:
    """Encoder and decoder over flat numpy tables."""

    def __init__(self, vocab: dict):
        pieces, kinds = vocab["pieces"], vocab["kinds"]
        self.n = len(pieces)
        self.base = self.n + 0x110000        # ids n + code point stand for unknown characters
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        self.of_char = np.arange(self.n, self.base, dtype=np.int64)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        levels = {s: r for r, s in enumerate(sorted({vocab["scores"][i] for i in normal.values()},
                                                    reverse=True))}
        level = {p: levels[vocab["scores"][i]] for p, i in normal.items()}

        def symbol(s):
            return normal.get(s, self.n + ord(s) if len(s) == 1 else None)
        keys, merged, ranks = [], [], []
        grows = {}                             # symbol -> best rank of a piece grown from it
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbol(p[:cut]), symbol(p[cut:])
                if a is None or b is None:
                    continue
                keys.append(a * self.base + b)
                merged.append(i)
                ranks.append(level[p])
                for x in (a, b):
                    grows[x] = min(grows.get(x, level[p]), level[p])
        self._build_pairs(keys, merged, ranks)
        used = np.bincount([levels[vocab["scores"][i]] for i in normal.values()],
                           minlength=len(levels))
        self.together = np.zeros(len(levels), dtype=bool)   # by rank: merge all places at once
        for p, i in normal.items():
            r = level[p]
            self.together[r] = used[r] == 1 and grows.get(i, len(levels)) > r
        self.longest = max(map(len, normal), default=1)
        self.one_word = any(SPACE in p.lstrip(SPACE) for p in normal)
        #: characters that no longer piece holds: words of their own
        self.loose = [ord(c) for c in "\n\r\t" if not any(c in p for p in normal if len(p) > 1)]
        self.of_byte = np.zeros(256, dtype=np.int64)
        surface = []
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                self.of_byte[int(p[3:5], 16)] = i
                surface.append(bytes([int(p[3:5], 16)]))
            else:
                surface.append(p.replace(SPACE, " ").encode() if k == "normal"
                               else " ⁇ ".encode() if k == "unknown" else b"")
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.width = np.array([len(s) for s in surface], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.width)])[:-1]
        self.opens = np.array([k == "normal" and p.startswith(SPACE)
                               for p, k in zip(pieces, kinds)])
        self._forget()

    def _build_pairs(self, keys, merged, ranks) -> None:
        """Open addressing: pair key -> rank and merged id, a few probes at most."""
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NEVER)
        self.merged = np.zeros(1 << self.bits, dtype=np.int64)
        self.probes = 1
        todo = np.arange(len(keys))
        keys, merged, ranks = (np.array(x, dtype=np.int64) for x in (keys, merged, ranks))
        slot = self._slot(keys)
        for self.probes in range(1, 200):
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            self.merged[slot[put]] = merged[put]
            todo = np.setdiff1d(todo, put)
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _forget(self):
        self.known: dict[int, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)

    def _rank(self, left, right):
        """(rank, merged id) of symbol pairs; ``NEVER`` where they form no piece."""
        key = left * self.base + right
        slot = self._slot(key)
        at = self.keys[slot]
        open_ = np.flatnonzero((at != key) & (at >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at[open_] = self.keys[slot[open_]]
            open_ = open_[(at[open_] != key[open_]) & (at[open_] >= 0)]
        return np.where(at == key, self.ranks[slot], NEVER), self.merged[slot]

    def _merge_words(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each word) of distinct words: their code points and sizes."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        long = (sizes > LONG_WORD)[word]
        sym, word = map(np.concatenate, zip(
            self._rounds(self.of_char[points[~long]], word[~long]),
            self._local_rounds(self.of_char[points[long]], word[long])))
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        unknown = np.flatnonzero(sym >= self.n)
        if len(unknown):
            raw = [chr(x).encode() for x in (sym[unknown] - self.n).tolist()]
            times = np.ones(len(sym), dtype=np.int64)
            times[unknown] = [len(b) for b in raw]
            put = np.repeat(np.arange(len(sym)) >= 0, times)
            is_raw = np.repeat(sym >= self.n, times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[is_raw & put] = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        ends = np.cumsum(np.bincount(word, minlength=len(sizes)))
        return sym.astype(np.int32), ends

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of every symbol with its right neighbour in the word."""
        rank = np.full(len(sym), NEVER)
        new = np.zeros(len(sym), dtype=np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], new[inside] = self._rank(sym[inside], sym[inside + 1])
        return rank, new

    def _local_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, words) after all merges. A round merges every pair that is better
        than all pairs within ``longest`` symbols, the left one of equals (or all of them,
        as above): whatever could take one of its symbols first would be a piece, no longer
        than that, which begins with a merge of a better pair nearby. So the rounds do not
        grow with the word."""
        rank, new = self._pairs(sym, word)
        reach = self.longest
        while True:
            closed = np.full(reach, NEVER)
            padded = np.concatenate([closed, rank, closed])
            least, have = padded, 1
            while have < reach:                  # least[i]: of padded[i : i + reach]
                step = min(have, reach - have)
                least = np.minimum(least[:-step], least[step:])
                have += step
            n = len(rank)
            left, right = least[:n], least[reach + 1:reach + 1 + n]
            c = np.flatnonzero((rank != NEVER) & (rank <= left) & (rank <= right))
            c = c[(rank[c] < left[c]) | self.together[rank[c]]]
            # of equal neighbouring pairs every other one, counted from where they begin
            begins = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            start = begins[np.searchsorted(begins, c, side="right") - 1]
            c = c[((c - start) % 2 == 0) & np.isin(start, c)]
            if not len(c):
                return sym, word
            sym[c] = new[c]
            keep = np.ones(n, dtype=bool)
            keep[c + 1] = False
            place = np.cumsum(keep)[c] - 1
            sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
            self._renew(sym, word, rank, new, place)

    def _renew(self, sym, word, rank, new, place) -> None:
        """Sets rank and merged id anew around merged symbols."""
        touched = np.unique(np.concatenate([place, place[place > 0] - 1]))
        has_next = touched + 1 < len(sym)
        rank[touched[~has_next]] = NEVER
        touched = touched[has_next]
        same = word[touched] == word[touched + 1]
        rank[touched[~same]] = NEVER
        t = touched[same]
        rank[t], new[t] = self._rank(sym[t], sym[t + 1])

    def _rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, words) after all merges, a word's best rank at a time."""
        rank, new = self._pairs(sym, word)
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.concatenate([starts, [len(sym)]]))
            of_symbol = np.repeat(best, spans)
            open_ = of_symbol != NEVER
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                sym, word, rank, new = sym[open_], word[open_], rank[open_], new[open_]
                of_symbol = of_symbol[open_]
                if not len(sym):
                    break
            c = np.flatnonzero(rank == of_symbol)
            first = np.concatenate([[True], word[c[1:]] != word[c[:-1]]])
            fresh = first.copy()
            fresh[1:] |= c[1:] != c[:-1] + 1
            run = c[np.maximum.accumulate(np.where(fresh, np.arange(len(c)), 0))]
            c = c[first | (self.together[rank[c]] & ((c - run) % 2 == 0))]
            sym[c] = new[c]
            keep = np.ones(len(sym), dtype=bool)
            keep[c + 1] = False
            place = np.cumsum(keep)[c] - 1
            sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
            self._renew(sym, word, rank, new, place)
        return (np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of the texts."""
        if len(self.known) > REMEMBERED_WORDS:
            self._forget()
        parts = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(x) for x in parts])
        begins = np.zeros(len(points) + 1, dtype=bool)
        begins[ends] = True
        begins[0] = True
        if not self.one_word:
            space = points == ord(SPACE)
            begins[1:-1] |= space[1:] & ~space[:-1]
            for c in self.loose:
                alone = points == c
                begins[:-1] |= alone
                begins[1:] |= alone
        cut = np.flatnonzero(begins)
        start, size = cut[:-1], np.diff(cut)
        h = Spans(points).hash(start, start + size)
        distinct, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
        known = self.known
        number = [known.get(x, -1) for x in distinct.tolist()]
        number = np.array(number, dtype=np.int64)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            s, n = start[sample[fresh]], size[sample[fresh]]
            at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids, ends_ = self._merge_words(points[at], n)
            number[fresh] = np.arange(len(known), len(known) + len(fresh))
            known.update(zip(distinct[fresh].tolist(), number[fresh].tolist()))
            self.ends = np.concatenate([self.ends, ends_ + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        w = number[inverse]
        n_words = np.searchsorted(start, ends, side="left")
        begin, size = self.ends[w], self.ends[w + 1] - self.ends[w]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return flat, total[np.concatenate([[0], n_words])]

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id sequences: surfaces in order, without the first piece's
        opening space; bytes that form no UTF-8 become U+FFFD."""
        size = self.width[flat]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.surface[np.repeat(self.at[flat] - total[:-1], size)
                           + np.arange(total[-1])].tobytes()
        out = []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            lo, hi = total[s], total[e]
            seen = np.flatnonzero(size[s:e])
            if len(seen) and self.opens[flat[s + seen[0]]]:
                lo += 1
            out.append(raw[lo:hi].decode("utf-8", "replace"))
        return out


def _broadcast(docs: DataFrame, model_path: str):
    return docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in a column ``ids`` (array of int;
    a column of that name is replaced)."""
    vocab = _broadcast(docs, model_path)

    def make():
        bpe = Bpe(vocab.value)

        def fn(texts):
            flat, offsets = bpe.encode(texts)
            return {ids: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                                  pa.array(flat))}
        return fn
    keys = [c for c in docs.columns if c != ids]
    return map_texts(docs, keys, text,
                     StructType([StructField(ids, ArrayType(IntegerType(), False))]), make)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids column in ``out``; NULL ids give an empty text."""
    vocab = _broadcast(docs, model_path)
    keys = [c for c in docs.columns if c != out]
    rows = docs.select(*map(named, keys))
    schema = StructType(rows.schema.fields + [StructField(out, StringType())])
    at = keys.index(ids)

    def run(batches):
        bpe = Bpe(vocab.value)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            sizes = [len(x) if x else 0 for x in lists]
            flat = np.array([i for x in lists if x for i in x], dtype=np.int64)
            texts = bpe.decode(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keys))] + [pa.array(texts, pa.string())],
                names=[*keys, out])
    return rows.mapInArrow(run, schema)


def token_digests(docs: DataFrame, model_path: str, keys: list[str],
                  text: str = "text") -> DataFrame:
    """Per document: n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256 (UTF-8 of the ids decoded again), without moving the ids."""
    vocab = _broadcast(docs, model_path)

    def make():
        bpe = Bpe(vocab.value)
        names = [str(i) for i in range(bpe.n)]

        def fn(texts):
            flat, offsets = bpe.encode(texts)
            each = flat.tolist()
            cuts = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            return {
                "n_tokens": pa.array([e - s for s, e in cuts], pa.int64()),
                "ids_sha256": [hashlib.sha256(",".join(map(names.__getitem__, each[s:e])).encode())
                               .hexdigest() for s, e in cuts],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest()
                                   for d in bpe.decode(flat, offsets)],
            }
        return fn
    schema = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                         StructField("decoded_sha256", StringType())])
    return map_texts(docs, keys, text, schema, make)
