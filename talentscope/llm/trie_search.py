"""Ranked lexical search by branch and bound over tries of document vectors.

Every document becomes a vector of the query vocabulary's terms it holds, ordered
from the rarest term to the most frequent one. Inside a task a bounded block of
vectors forms a trie whose paths are shared by documents with the same rarest
terms. A node knows, for every term below it, the largest frequency, and the least
length factor ``m``: an upper bound of any item's scores in its subtree. Each item
is searched depth first, the most promising nodes first; a subtree whose bound is
below the item's tenth best score is left out, and what is reached is scored
exactly. A task keeps the best of all its blocks; two windows merge the tasks.

Term weights need corpus counts, so a first pass counts every document's terms and
writes the restricted vectors to the shared folder; the tries are built from there.

Broadcast: the vocabulary of one block of items (``BLOCK_BYTES`` of item text at
most, a single longer item excepted); further blocks are further passes.

Defined cases: NULL, empty and term-less texts are no documents of the statistics
and are never found; an item without terms has no rows; equal scores go by
ascending id, NULL ids last; repeated document rows are documents of their own, and
so are repeated item rows; ids are integers (others fail the cast); further columns,
whatever their names, are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StructField, StructType)

from talentscope.llm.arrow_rows import slices
from talentscope.llm.common import staged

#: Bytes of item text whose vocabulary is broadcast at once.
BLOCK_BYTES = 16 << 20
#: Terms of the items that share a table, and cells of one: tries hold as many documents
#: as fit (their nodes, at most as many again, besides).
GROUP_TERMS, CELLS = 1 << 12, 1 << 24
#: Subtrees of at most so many documents have no nodes below; nodes looked into at first.
LEAF, FIRST = 4, 4
#: First merge of the tasks' best rows: groups an item's rows are dealt to.
SALTS = 32
NO_ID = np.iinfo(np.int64).max
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
                 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """ASCII letters (A-Z lowered), digits and all characters above ASCII, in runs."""
    return text.encode().translate(_LETTERS).split() if text else []


def length_factor(n, n_docs: int, n_terms: int):
    return 25 + (75 * n * n_docs) // n_terms


def term_value(weight, tf, m):
    """What ``tf`` occurrences add to the score of a document with factor ``m``."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _item_blocks(items: DataFrame, item_id: str, text: str):
    """[(item id, its terms)] per block of items that have terms."""
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).filter(
        "t <> ''")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = math.ceil(size / BLOCK_BYTES)
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        found = [(r["i"], terms_of(r["t"])) for r in part.collect()]
        found = [x for x in found if x[1]]
        if found:
            yield found


def restricted_vectors(docs: DataFrame, vocabulary: list[bytes], doc_id: str,
                       text: str) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: all its terms' number, and
    the vocabulary numbers and frequencies of those in the vocabulary."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = StructType([StructField("id", LongType()), StructField("n", LongType()),
                         StructField("terms", ArrayType(IntegerType(), False)),
                         StructField("tfs", ArrayType(IntegerType(), False))])

    def run(batches):
        number = {w: i for i, w in enumerate(words.value)}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in slices(texts):
                sizes, flat = [], []
                for t in texts[s:e]:
                    ws = terms_of(t)
                    sizes.append(len(ws))
                    flat.extend(map(number.get, ws, repeat(-1)))
                sizes = np.array(sizes, dtype=np.int64)
                flat = np.array(flat, dtype=np.int64)
                doc = np.repeat(np.arange(e - s), sizes)[flat >= 0]
                key, tf = np.unique(doc * len(number) + flat[flat >= 0], return_counts=True)
                doc, term = np.divmod(key, max(1, len(number)))
                full = np.flatnonzero(sizes)
                ends = np.concatenate([[0], np.searchsorted(doc, full, side="right")])
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                                  pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s).take(pa.array(full)),
                     pa.array(sizes[full]), *lists], names=schema.names)
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"),
                       F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)


class Trie:
    """Vectors of a block of documents in lexicographic order of their ranks. A node is
    the range of documents that share a path; only nodes whose documents differ from
    their parent's exist. Rows 0 .. n-1 stand for documents, the others for nodes, and
    hold (rank, largest frequency) with the least length factor below."""

    def __init__(self, offsets, rank, tf, m, ids, k: int):
        keep = self._ordered(offsets, rank, tf, m, ids, k)
        sizes = np.diff(offsets)[keep]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(offsets[keep] - self.offsets[:-1], sizes) + np.arange(self.offsets[-1])
        self.rank, self.tf, self.m, self.ids = rank[at], tf[at], m[keep], ids[keep]
        self.n = len(keep)
        self._grow()

    @staticmethod
    def _ordered(offsets, rank, tf, m, ids, k) -> np.ndarray:
        """Order of the documents that hold a term; of those equal in vector and factor,
        which score alike, the ``k`` of least id."""
        raw, times = rank.astype(">u4").tobytes(), tf.astype(">u4").tobytes()
        cuts = (offsets * 4).tolist()
        keys = [(raw[s:e], times[s:e], f, i) for s, e, f, i in
                zip(cuts[:-1], cuts[1:], m.tolist(), ids.tolist())]
        keep, before, seen = [], None, 0
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            seen = seen + 1 if keys[i][:3] == before else 1
            before = keys[i][:3]
            if seen <= k and before[0]:
                keep.append(i)
        return np.array(keep, dtype=np.int64)

    def _grow(self):
        sizes = np.diff(self.offsets)
        none = np.zeros(0, dtype=np.int64)
        self.row, self.row_rank, self.row_tf, self.row_m = (
            [np.repeat(np.arange(self.n), sizes)], [self.rank], [self.tf], [np.repeat(self.m, sizes)])
        self.lo, self.hi = np.array([0]), np.array([self.n])
        self.scored, self.first, self.last = (np.zeros(1, dtype=np.int64) for _ in range(3))
        fresh, active, depth = np.array([0]), np.array([0]), 0
        while len(fresh) or len(active):
            self._describe(fresh)
            narrow = fresh[self.hi[fresh] - self.lo[fresh] <= LEAF]
            self.scored[narrow] = self.hi[narrow]
            active = active[self.hi[active] - self.lo[active] > LEAF]
            lo, span = self.lo[active], self.hi[active] - self.lo[active]
            docs = np.repeat(lo - (np.cumsum(span) - span), span) + np.arange(span.sum())
            node = np.repeat(np.arange(len(active)), span)
            goes = sizes[docs] > depth
            stops = np.bincount(node[~goes], minlength=len(active))
            docs, node = docs[goes], node[goes]
            r = self.rank[self.offsets[docs] + depth]
            starts = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (r[1:] != r[:-1])])
                                    ) if len(r) else none
            kids = np.bincount(node[starts], minlength=len(active))
            same = (kids == 1) & (stops == 0)          # the path goes on with all documents
            parent = node[starts]
            begin = docs[starts]
            end = np.concatenate([docs[starts[1:] - 1], docs[-1:]]) + 1
            new = ~same[parent]
            kids = np.where(same, 0, kids)
            self.scored[active] = lo + stops
            self.last[active] = len(self.lo) + np.cumsum(kids)
            self.first[active] = self.last[active] - kids
            fresh = np.arange(len(self.lo), len(self.lo) + new.sum())
            self.lo, self.hi = np.concatenate([self.lo, begin[new]]), np.concatenate([self.hi, end[new]])
            self.scored, self.first, self.last = (
                np.concatenate([x, np.zeros(len(fresh), dtype=np.int64)])
                for x in (self.scored, self.first, self.last))
            active = np.concatenate([active[same], fresh])
            active = active[np.argsort(self.lo[active], kind="stable")]
            depth += 1
        self.row, self.row_rank, self.row_tf, self.row_m = map(
            np.concatenate, (self.row, self.row_rank, self.row_tf, self.row_m))

    def _describe(self, nodes: np.ndarray) -> None:
        """Adds the nodes' rows: each term's largest frequency, the least factor."""
        if not len(nodes) or not self.n:
            return
        lo, hi = self.offsets[self.lo[nodes]], self.offsets[self.hi[nodes]]
        span = hi - lo
        at = np.repeat(lo - (np.cumsum(span) - span), span) + np.arange(span.sum())
        key = np.repeat(nodes, span) << 32 | self.rank[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        row, rank = key[starts] >> 32, key[starts] & ((1 << 32) - 1)
        wide = self.hi[nodes] - self.lo[nodes]
        docs = np.repeat(self.lo[nodes] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        least = np.minimum.reduceat(self.m[docs], np.cumsum(wide) - wide)
        self.row.append(row + self.n)
        self.row_rank.append(rank)
        self.row_tf.append(np.maximum.reduceat(self.tf[at[order]], starts))
        self.row_m.append(least[np.searchsorted(nodes, row)])

    def table(self, ranks: np.ndarray, terms: int) -> np.ndarray:
        """(term of ``ranks``, row) -> what the term gives the row, without its weight."""
        column = np.full(terms, -1)
        column[ranks] = np.arange(len(ranks))
        at = column[self.row_rank]
        use = at >= 0
        out = np.zeros((len(ranks), self.n + len(self.lo)), dtype=np.int32)
        out[at[use], self.row[use]] = term_value(1, self.row_tf[use], self.row_m[use])
        return out

    def search(self, table: np.ndarray, columns: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offers ``best`` every document that may be among the best of one item, of
        terms ``columns`` with ``weights``; returns how many were scored."""
        def values(rows):
            return weights @ table[np.ix_(columns, rows)]
        stack, scored = [(np.array([0]), values(np.array([self.n])), FIRST)] if self.n else [], 0
        while stack:
            nodes, bound, step = stack.pop()
            alive = bound >= best.needed
            nodes, bound = nodes[alive], bound[alive]
            if not len(nodes):
                continue
            # the most promising first, in steps that grow: the first raise what the others need
            order = np.argsort(-bound, kind="stable")
            if len(order) > step:
                stack.append((nodes[order[step:]], bound[order[step:]], 4 * step))
            nodes = nodes[order[:step]]
            n = self.scored[nodes] - self.lo[nodes]
            if n.any():
                docs = np.repeat(self.lo[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                best.offer(values(docs), self.ids[docs])
                scored += len(docs)
            kids = self.last[nodes] - self.first[nodes]
            if kids.any():
                child = np.repeat(self.first[nodes] - (np.cumsum(kids) - kids), kids) + np.arange(kids.sum())
                stack.append((child, values(self.n + child), FIRST))
        return scored


class Best:
    """The ``k`` highest (score, least id) of an item so far."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.id = np.zeros(0, dtype=np.int64)
        #: a lower score cannot enter any more; scores of 0 never do
        self.needed = 1

    def offer(self, score, ids) -> None:
        use = score >= self.needed
        if not use.any():
            return
        score, ids = np.concatenate([self.score, score[use]]), np.concatenate([self.id, ids[use]])
        order = np.lexsort((ids, -score))[:self.k]
        self.score, self.id = score[order], ids[order]
        if len(order) == self.k:
            self.needed = max(1, int(self.score[-1]))


class ItemGroup:
    """Items searched with one table: the ranks of their terms, and of each item the
    table's columns, the weights times occurrences, and the best documents so far."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, k: int):
        self.ranks = np.unique(np.concatenate([r for _, r, _ in items]))
        self.items = [(i, np.searchsorted(self.ranks, r), weights[r] * n, Best(k)) for i, r, n in items]


def _item_groups(found: list, number: dict, rank_of: np.ndarray, weights: np.ndarray,
                 k: int) -> list[ItemGroup]:
    """Items in order, in groups of at most ``GROUP_TERMS`` terms (or one item)."""
    out, group, terms = [], [], set()
    for i, (_, ws) in enumerate(found):
        ranks, times = np.unique(rank_of[[number[w] for w in ws]], return_counts=True)
        if group and len(terms.union(ranks.tolist())) > GROUP_TERMS:
            out.append(ItemGroup(group, weights, k))
            group, terms = [], set()
        group.append((i, ranks, times))
        terms.update(ranks.tolist())
    return [*out, ItemGroup(group, weights, k)]


def _tries(batches, rank_of, n_docs, n_terms, k, most_docs):
    for batch in batches:
        ids = batch.column(0).fill_null(int(NO_ID)).to_numpy()
        m = length_factor(batch.column(1).to_numpy(), n_docs, n_terms)
        lists = batch.column(2)
        cuts = np.asarray(lists.offsets, dtype=np.int64)
        term = lists.values.to_numpy()
        tf = batch.column(3).values.to_numpy().astype(np.int64)
        for s in range(0, len(ids), most_docs):
            e = min(len(ids), s + most_docs)
            doc = np.repeat(np.arange(e - s), np.diff(cuts[s:e + 1]))
            r = rank_of[term[cuts[s]:cuts[e]]]
            order = np.lexsort((r, doc))
            yield Trie(cuts[s:e + 1] - cuts[s], r[order], tf[cuts[s]:cuts[e]][order], m[s:e], ids[s:e], k)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of highest score."""
    spark = docs.sparkSession
    item_type = items.schema[item_id].dataType
    rows = StructType([StructField("entry", LongType()), StructField("item", item_type),
                       StructField("doc", LongType()), StructField("score", LongType())])
    out = None
    for found in _item_blocks(items, item_id, item_text):
        vocabulary = sorted({w for _, ws in found for w in ws})
        vectors = staged(restricted_vectors(docs, vocabulary, doc_id, text), "vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
        by_rank = np.argsort(df, kind="stable")            # rarest first
        rank_of = np.empty_like(by_rank)
        rank_of[by_rank] = np.arange(len(by_rank))
        shared = spark.sparkContext.broadcast(
            (found, {w: i for i, w in enumerate(vocabulary)}, rank_of,
             np.array(weight, dtype=np.int64)[by_rank]))

        def run(batches, shared=shared, n_docs=n_docs, n_terms=n_terms):
            found, number, rank_of, weights = shared.value
            groups = _item_groups(found, number, rank_of, weights, k)
            most = max(len(g.ranks) for g in groups)
            for trie in _tries(batches, rank_of, n_docs, n_terms, k, max(16, CELLS // most)):
                for g in groups:
                    table = trie.table(g.ranks, len(rank_of))
                    for _, columns, weight, best in g.items:
                        trie.search(table, columns, weight, best)
            names = pa.array([i for i, _ in found], to_arrow_type(item_type))
            for g in groups:
                entry = pa.array(np.repeat([i for i, *_ in g.items], [len(b.id) for *_, b in g.items]), pa.int64())
                ids = np.concatenate([b.id for *_, b in g.items])
                yield pa.RecordBatch.from_arrays(
                    [entry, names.take(entry), pa.array(ids, mask=ids == NO_ID),
                     pa.array(np.concatenate([b.score for *_, b in g.items]))], names=rows.names)
        part = vectors.select("id", "n", "terms", "tfs").mapInArrow(run, rows)
        order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
        for keys in (["entry", F.pmod(F.xxhash64("doc"), F.lit(SALTS))], ["entry"]):
            part = part.withColumn("rank", F.row_number().over(
                Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
        part = part.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], StructType(
        [StructField(item_id, item_type), StructField("rank", IntegerType()),
         StructField(doc_id, LongType()), StructField("score", LongType())]))
