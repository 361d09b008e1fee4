"""Suffix-array deduplication of repeated byte strings across documents.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. All suffixes of a large corpus need no common order
for that; it is enough to order those whose first ``length`` bytes may repeat:

1. Documents are packed into blocks of a few MB (compressed, in a table that is
   bucketed by block, so texts are never shuffled).
2. Every block picks anchors: the positions of least hash among ``WIDTH`` adjacent
   substrings of ``GRAM`` bytes. Any two equal strings of ``length`` bytes contain
   the same anchor at the same place. Anchors are exchanged in packed form by the
   hash of their substring, with a digest of their context (all bytes that any
   string of that length around the anchor can reach).
3. An anchor whose context also occurs in a smaller document resolves all strings
   around it. A string whose own anchor has one context only is either resolved or
   unique. What is left are strings whose anchor occurs in differing contexts.
4. The suffixes of those strings are ordered in every block by deep-shallow
   sorting; equal neighbours fall together, and one entry per distinct string is
   exchanged to find its smallest document.

Hot substrings: a block sends one entry per substring and context, with the
smallest id; where a block holds more than ``MANY`` contexts of one substring, all
but a marker are dealt by the context instead. Contexts are compared by 80 bits and
more within a bucket, strings by 88.

Defined cases: NULL and short texts lose nothing; repeated rows with the same id
do not remove each other's bytes; documents with a NULL id neither lose bytes nor
cause a loss; other columns are ignored by the report and kept by ``dedup``.
Cutting may split a UTF-8 character; ``dedup`` widens a cut to whole characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from talentscope.llm.common import bucket_count, named, noted, shared_path, staged
from talentscope.llm.hashing import Spans, U, mix
from talentscope.llm.ngram_join import _spread_ids
from talentscope.llm.suffix_sort import big_endian, deep_shallow

LENGTH = 50
GRAM = 24
BLOCK_BYTES = 2 << 20            # text bytes of a block (a longer document is a block)
BUCKET_BYTES = 12 << 20          # text bytes per bucket of the exchanges, about
BLOCK_DOCS = 60_000              # so that two bytes number a block's ids
PARTITION_BYTES = 32 << 20       # text bytes per partition of blocks, about
MANY = 16
NO_ID = np.iinfo(np.int64).min

RESOLVED, MIXED = 1, 2                        # flags of anchors


# --- blocks -----------------------------------------------------------------

def pack_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                carry: list[str] | None = None, buckets: int = 8) -> DataFrame:
    """(block, data) rows with the documents of each block, and their columns
    ``carry`` as an Arrow stream: a table in the shared folder, bucketed by block,
    so that what later steps know about a block comes to it, not the reverse."""
    carry = carry or []
    src = docs.select(named(doc_id).cast("bigint").alias("id"), named(text).alias("text"),
                      *[named(c).alias(f"c{i}") for i, c in enumerate(carry)])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, texts, rest, size = [], [], [], 0
        press = zstandard.ZstdCompressor(level=6)

        def block():
            sizes = np.array([-1 if t is None else len(t) for t in texts], dtype=np.int64)
            sink = pa.BufferOutputStream()
            if carry:
                t = pa.Table.from_batches(rest)
                with pa.ipc.new_stream(sink, t.schema) as w:
                    w.write_table(t)
            extra = press.compress(sink.getvalue().to_pybytes())
            data = (np.array([len(ids), len(extra)], dtype=np.int64).tobytes()
                    + np.array(ids, dtype=np.int64).tobytes() + sizes.tobytes() + extra
                    + press.compress(b"".join(t or b"" for t in texts)))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([data], pa.binary())],
                names=["block", "data"])
        for batch in batches:
            begin = 0
            others = batch.select(range(2, 2 + len(carry)))
            for at, (i, t) in enumerate(zip(batch.column(0), batch.column(1))):
                i, t = i.as_py(), t.as_py()
                ids.append(NO_ID if i is None else i)
                texts.append(None if t is None else t.encode())
                size += len(texts[-1] or b"")
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    rest.append(others.slice(begin, at + 1 - begin))
                    begin = at + 1
                    yield block()
                    number += 1
                    ids, texts, rest, size = [], [], [], 0
            rest.append(others.slice(begin))
        if ids:
            yield block()
    spark = docs.sparkSession
    path = noted(shared_path(spark, "blocks"))
    name = noted(f"blocks_{path.rpartition('-')[2]}")
    (src.mapInArrow(run, "block bigint, data binary").write.bucketBy(buckets, "block")
     .option("path", path).saveAsTable(name))
    return spark.table(name)


class Block:
    """The documents of a block over one byte buffer."""

    def __init__(self, data: bytes, length: int):
        n, extra = np.frombuffer(data, np.int64, 2).tolist()
        self.ids = np.frombuffer(data, np.int64, n, 16)
        sizes = np.frombuffer(data, np.int64, n, 16 + 8 * n)
        at = 16 + 16 * n
        self.extra = data[at:at + extra]
        self.null = sizes < 0
        sizes = np.maximum(sizes, 0)
        self.bytes = zstandard.ZstdDecompressor().decompress(data[at + extra:])
        self.raw = np.frombuffer(self.bytes, dtype=np.uint8)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.length = length

    def carried(self) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self.extra)).read_all()

    def anchors(self) -> None:
        """Sets ``at`` (anchor positions), ``doc``, the hashes of their substrings
        (``gram``) and contexts (``context``); and for every string of ``length``
        bytes its start (``begin``) and the number of its anchor (``owner``)."""
        reach = self.length - GRAM
        width = reach + 1
        raw, n = self.raw, len(self.raw)
        usable = (self.end - self.start >= self.length) & (self.ids != NO_ID)
        self.spans = spans = Spans(raw)
        if n < self.length or not usable.any():
            at = np.zeros(0, dtype=np.int64)
            self.begin = self.owner = np.zeros(0, dtype=np.int32)
        else:
            best = spans.least_in_windows(GRAM, width)
            room = (self.end - self.start - self.length + 1)[usable]
            first = self.start[usable] - (np.cumsum(room) - room)
            begin = (np.arange(room.sum(), dtype=best.dtype)
                     + np.repeat(first, room).astype(best.dtype))   # strings of usable documents
            at = best[begin]                         # never decreases along the buffer
            fresh = np.concatenate([[True], at[1:] != at[:-1]])
            self.begin = begin
            self.owner = np.cumsum(fresh, dtype=np.int32) - 1
            at = at[fresh].astype(np.int64)
        self.at = at
        self.doc = np.searchsorted(self.end, at, side="right")
        self.gram = spans.hash(at, at + GRAM) if len(at) else np.zeros(0, dtype=np.uint64)
        lo = np.maximum(self.start[self.doc], at - reach)
        hi = np.minimum(self.end[self.doc], at + GRAM + reach)
        self.context = (spans.hash(lo, hi, 17) ^ mix((at - lo).astype(np.uint64))
                        if len(at) else self.gram)


def _entries(block: Block, n_buckets: int):
    """The block's exchange entries: per substring and context the smallest id.

    Returns (entry of each anchor, flags known already, and per entry: bucket, gram,
    context, id). The last entries are markers, which have no anchor."""
    g, c, ids = block.gram, block.context, block.ids[block.doc]
    order = np.lexsort((c, g))
    g, c, ids = g[order], c[order], ids[order]
    fresh = np.ones(len(g), dtype=bool)
    fresh[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    entry = np.empty(len(g), dtype=np.int64)
    entry[order] = np.cumsum(fresh) - 1
    ids = np.minimum.reduceat(ids, np.flatnonzero(fresh)) if len(g) else ids
    g, c = g[fresh], c[fresh]
    of = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1 if len(g) else np.zeros(0, int)
    many = np.bincount(of)[of] > MANY if len(g) else np.zeros(0, bool)
    bucket = np.where(many, mix(g ^ c), g) >> U(40)
    local = np.where(many, MIXED, 0).astype(np.uint8)
    mark = np.flatnonzero(many & np.concatenate([[True], of[1:] != of[:-1]])) if len(g) else []
    bucket = np.concatenate([bucket, g[mark] >> U(40), g[mark] >> U(40)]) % U(n_buckets)
    context = np.concatenate([c, np.full(len(mark), U(0)), np.full(len(mark), U(1))])
    gram = np.concatenate([g, g[mark], g[mark]])
    ids = np.concatenate([ids, ids[mark], ids[mark]])
    return entry, local, bucket.astype(np.int64), gram, context, ids


def _dealt(bucket: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries in order of their bucket, first of each bucket). Both ends of an
    exchange use this order, so entries need no numbers on the way."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def _payloads(block: int, bucket: np.ndarray, bucket_ids: np.ndarray, columns: list[np.ndarray],
              doc_ids: np.ndarray) -> pa.RecordBatch:
    """One (bucket, data) row per bucket: the columns of its entries and their
    document ids (once per payload, as packed differences, with two-byte numbers)."""
    order, cuts = _dealt(bucket, len(bucket_ids))
    press = zstandard.ZstdCompressor(level=3)
    out_b, out_d = [], []
    for b in range(len(bucket_ids)):
        pick = order[cuts[b]:cuts[b + 1]]
        if not len(pick):
            continue
        own, local = np.unique(doc_ids[pick], return_inverse=True)
        out_b.append(int(bucket_ids[b]))
        packed = press.compress(np.diff(own, prepend=0).tobytes())
        out_d.append(b"".join([
            np.array([block, b, len(pick), len(packed)], dtype=np.int64).tobytes(), packed,
            local.astype(np.uint16).tobytes(), *[x[pick].tobytes() for x in columns]]))
    return pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_d, pa.binary())],
                                      names=["bucket", "data"])


def _read_payload(data: bytes, widths: list[int]):
    block, bucket, n, m = np.frombuffer(data, np.int64, 4).tolist()
    at = 32
    own = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:at + m]), np.int64))
    at += m
    local = np.frombuffer(data, np.uint16, n, at)
    at += 2 * n
    cols = []
    for w in widths:
        cols.append(_wide(data, at, n, w))
        at += w * n
    return block, bucket, own[local], cols


def _narrow(x: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].copy()


def _wide(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").ravel()


def _gather(batches, column: int, widths: list[int]):
    """The payloads of a partition: (block, bucket, place in the payload, ids, columns)."""
    parts = [_read_payload(d.as_py(), widths) for b in batches for d in b.column(column)]
    if not parts:
        return None
    n = [len(p[2]) for p in parts]
    return (np.repeat(np.array([p[0] for p in parts], dtype=np.int64), n),
            np.repeat(np.array([p[1] for p in parts], dtype=np.int32), n),
            np.concatenate([np.arange(k, dtype=np.int32) for k in n]),
            np.concatenate([p[2] for p in parts]),
            [np.concatenate(x) for x in zip(*(p[3] for p in parts))])


def _reply(block: np.ndarray, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One (block, data) row per block and bucket with the packed columns."""
    order = np.lexsort((bucket, block))
    block, bucket = block[order], bucket[order]
    fresh = np.concatenate([[True], (block[1:] != block[:-1]) | (bucket[1:] != bucket[:-1])])
    cuts = np.append(np.flatnonzero(fresh), len(block))
    ids, data = [], []
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        ids.append(int(block[s]))
        data.append(np.array([bucket[s], e - s], dtype=np.int64).tobytes()
                    + b"".join(x[order[s:e]].tobytes() for x in columns))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())],
                                      names=["block", "data"])


def _with_replies(blocks: DataFrame, replies: dict[str, DataFrame], fn, schema) -> DataFrame:
    """``fn(block, text, {name: [data]})`` for every block. The block table is
    bucketed by block, so only the (small) replies are shuffled to it."""
    names = list(replies)
    rows = blocks
    for name, df in replies.items():
        lists = df.groupBy("block").agg(F.collect_list("data").alias(name))
        rows = rows.join(lists.hint("shuffle_hash"), "block", "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield from fn(row.column(0)[0].as_py(), row.column(1)[0].as_py(), {
                    k: row.column(2 + j)[0].as_py() or [] for j, k in enumerate(names)})
    return rows.select("block", "data", *names).mapInArrow(run, schema)


# --- the two exchanges ------------------------------------------------------

def _anchor_flags(blocks: DataFrame, bucket_ids: np.ndarray, length: int) -> DataFrame:
    """(block, data) replies: places and flags of all entries that have flags."""
    n_buckets = len(bucket_ids)

    def send(batches):
        for batch in batches:
            for number, data in zip(batch.column(0), batch.column(1)):
                block = Block(data.as_py(), length)
                block.anchors()
                if len(block.at):
                    _, _, bucket, gram, context, ids = _entries(block, n_buckets)
                    yield _payloads(number.as_py(), bucket, bucket_ids,
                                    [_narrow(gram, 4), _narrow(context, 6)], ids)

    def meet(batches):
        got = _gather(batches, 1, [4, 6])
        if got is None:
            return
        block, bucket, place, ids, (gram, context) = got
        gram |= bucket.astype(np.uint64) << U(32)
        order = np.lexsort((ids, context, gram))
        gram, context, ids = gram[order], context[order], ids[order]
        new_g = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_c = new_g | np.concatenate([[True], context[1:] != context[:-1]])
        g, c = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
        flags = np.where(ids > ids[np.flatnonzero(new_c)][c], RESOLVED, 0)
        contexts = np.bincount(g[np.flatnonzero(new_c)])
        flags |= np.where(contexts[g] > 1, MIXED, 0)
        pick = np.flatnonzero(flags)
        if len(pick):
            at = order[pick]
            yield _reply(block[at], bucket[at], place[at], flags[pick].astype(np.uint8))
    return (blocks.mapInArrow(send, "bucket int, data binary").repartition(n_buckets, "bucket")
            .mapInArrow(meet, "block bigint, data binary"))


def _flags_of(data: list[bytes], n: int, bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """The flags of the first ``n`` entries (the others are markers)."""
    out = np.zeros(len(bucket), dtype=np.uint8)
    order, cuts = _dealt(bucket, n_buckets)
    for d in data:
        b, m = np.frombuffer(d, np.int64, 2).tolist()
        at = order[cuts[b] + np.frombuffer(d, np.int32, m, 16)]
        out[at] |= np.frombuffer(d, np.uint8, m, 16 + 4 * m)
    return out[:n]


def _undecided(block: Block, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of strings still to order, covered bytes as a difference array)."""
    n, length = len(block.raw), block.length
    cover = np.zeros(n + 1, dtype=np.int32)
    around = np.zeros(n + 1, dtype=np.int32)          # resolved anchors of a start
    lo = np.maximum(block.start[block.doc], block.at - (length - GRAM))
    hi = np.minimum(block.at, block.end[block.doc] - length)
    resolved = flags & RESOLVED > 0
    np.add.at(cover, lo[resolved], 1)
    np.add.at(cover, hi[resolved] + length, -1)
    np.add.at(around, lo[resolved], 1)
    np.add.at(around, hi[resolved] + 1, -1)
    left = (flags[block.owner] == MIXED) & (np.cumsum(around, dtype=np.int32)[block.begin] == 0)
    starts = block.begin[left].astype(np.int64)
    return starts, cover


def _ordered(block: Block, flags: list[bytes], n_buckets: int):
    """(starts in order, group of each, least id of each group, cover) of the strings
    still to decide; None for a block without anchors."""
    block.anchors()
    if not len(block.at):
        return None
    entry, local, bucket, _, _, least = _entries(block, n_buckets)
    known = (_flags_of(flags, len(local), bucket, n_buckets) | local)[entry]
    known |= np.where(block.ids[block.doc] > least[entry], RESOLVED, 0).astype(np.uint8)
    starts, cover = _undecided(block, known)
    rank, group = deep_shallow(block.raw, starts, block.length)
    starts = starts[rank]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, block.ids[np.searchsorted(block.end, starts, side="right")])
    return starts, group, least, cover


def _strings(blocks: DataFrame, flags: DataFrame, bucket_ids: np.ndarray,
             length: int) -> DataFrame:
    """(bucket, data): the distinct undecided strings of each block with the smallest
    id in the block."""
    n_buckets = len(bucket_ids)

    def send(number, text, replies):
        block = Block(text, length)
        got = _ordered(block, replies["flags"], n_buckets)
        if got and len(got[2]):
            starts, group, least, _ = got
            bucket, h, h2 = _string_keys(block, starts, group, len(least), n_buckets)
            yield _payloads(number, bucket, bucket_ids, [_narrow(h, 8), _narrow(h2, 3)], least)
    return _with_replies(blocks, {"flags": flags}, send, "bucket int, data binary")


def _string_keys(block: Block, starts: np.ndarray, group: np.ndarray, n_groups: int,
                 n_buckets: int):
    """(bucket, digest, more of it) of each group's string."""
    head = starts[np.searchsorted(group, np.arange(n_groups))]
    h = block.spans.hash(head, head + block.length, 29)
    ends = mix(big_endian(block.raw, head) * U(0x9E3779B97F4A7C15)
               + big_endian(block.raw, head + block.length - 8))
    return ((h >> U(40)) % U(n_buckets)).astype(np.int64), h, ends


def _smallest_ids(strings: DataFrame, n_buckets: int) -> DataFrame:
    """(block, data) replies: places and smallest ids of the strings for which
    another block has a smaller document."""
    def meet(batches):
        got = _gather(batches, 1, [8, 3])
        if got is None:
            return
        block, bucket, place, ids, (h, h2) = got
        order = np.lexsort((ids, h2, h))
        h, h2, ids = h[order], h2[order], ids[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
        least = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        pick = np.flatnonzero(least < ids)
        if len(pick):
            at = order[pick]
            yield _reply(block[at], bucket[at], place[at], least[pick])
    return (strings.repartition(n_buckets, "bucket")
            .mapInArrow(meet, "block bigint, data binary"))


def _covered(block: Block, replies: dict, n_buckets: int) -> np.ndarray:
    """Boolean per byte of the block: covered by a string of a smaller document. The
    order of the strings is found again rather than stored: it is larger than the
    text it orders."""
    n = len(block.raw)
    got = _ordered(block, replies["flags"], n_buckets)
    if got is None:
        return np.zeros(n, dtype=bool)
    starts, group, least, cover = got
    if replies["found"]:
        bucket, _, _ = _string_keys(block, starts, group, len(least), n_buckets)
        order, cuts = _dealt(bucket, n_buckets)
        for d in replies["found"]:
            b, m = np.frombuffer(d, np.int64, 2).tolist()
            g = order[cuts[b] + np.frombuffer(d, np.int32, m, 16)]
            least[g] = np.minimum(least[g], np.frombuffer(d[16 + 4 * m:], np.int64, m))
    if len(starts):
        gone = starts[block.ids[np.searchsorted(block.end, starts, side="right")] > least[group]]
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + block.length, -1)
    return np.cumsum(cover)[:n] > 0


def _run(docs: DataFrame, doc_id: str, text: str, length: int, carry: list[str], finish,
         schema) -> DataFrame:
    """The whole method; ``finish(block, covered)`` yields the output batches."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(named(text)))).first()[0] or 0
    blocks = pack_blocks(docs, doc_id, text, carry, bucket_count(spark, size, PARTITION_BYTES))
    n_buckets = bucket_count(spark, size, BUCKET_BYTES)
    # numbers that a hash partitioning of n spreads evenly
    bucket_ids = _spread_ids(spark, n_buckets)
    flags = staged(_anchor_flags(blocks, bucket_ids, length), "flags")
    found = staged(_smallest_ids(_strings(blocks, flags, bucket_ids, length), n_buckets), "found")

    def last(number, text_, replies):
        block = Block(text_, length)
        yield from finish(block, _covered(block, replies, n_buckets))
    return _with_replies(blocks, {"flags": flags, "found": found}, last, schema)


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()),
                         StructField("n_removed", LongType()), StructField("n_spans", LongType()),
                         StructField("kept_sha256", StringType())])

    def finish(block, covered):
        removed = np.concatenate([[0], np.cumsum(covered)])
        rows = []
        for i, s, e in zip(block.ids.tolist(), block.start.tolist(), block.end.tolist()):
            gone = int(removed[e] - removed[s])
            own = covered[s:e]
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if gone else 0
            kept = block.raw[s:e][~own].tobytes() if gone else block.bytes[s:e]
            rows.append((None if i == NO_ID else i, e - s, gone, spans,
                         hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64())
             for k in range(5)], names=schema.names)
    return _run(docs, doc_id, text, length, [], finish, schema)


def whole_characters(raw: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """``covered`` widened so that no UTF-8 character is cut in part."""
    if not covered.any():
        return covered
    char = np.cumsum(raw & 0xC0 != 0x80)
    return (np.bincount(char, weights=covered) > 0)[char]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars",
          length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes, with the same columns; ``n_chars``, where
    present, is set anew for cut texts. A document of which only white space is
    left is dropped."""
    schema = docs.schema
    carry = [c for c in schema.names if c != text]

    def finish(block, covered):
        texts, kept, sizes = [], [], []
        for s, e, null in zip(block.start.tolist(), block.end.tolist(), block.null.tolist()):
            own = whole_characters(block.raw[s:e], covered[s:e])
            cut = bool(own.any())
            t = (block.raw[s:e][~own].tobytes() if cut else block.bytes[s:e]).decode()
            texts.append(None if null else t)
            kept.append(not cut or bool(t.strip()))
            sizes.append(len(t) if cut else None)
        rest = block.carried()
        columns = []
        for c in schema.names:
            if c == text:
                columns.append(pa.array(texts, pa.string()))
                continue
            col = rest.column(carry.index(c)).combine_chunks()
            if c == n_chars:
                new = pa.array(sizes, pa.int64()).cast(col.type)
                col = pc.coalesce(new, col)
            columns.append(col)
        yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(kept))
    return _run(docs, doc_id, text, length, carry, finish, schema)
