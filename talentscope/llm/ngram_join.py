"""N-gram Jaccard join by a token-group matrix.

Documents are sets of distinct word shingles (5 words unless told otherwise) and
link when their Jaccard similarity reaches 75 %. Equal sets form a class first.

1. A fixed order of all shingles (rare before frequent) gives each class a
   prefix, such that linked classes share a prefix shingle. Prefixes are exchanged
   in packed blocks, by shingle.
2. Grouping: every class gets a few leaders among the classes that share a prefix
   shingle and a size band with it (stars, not all pairs) and is compared with
   them exactly. The classes with the same best leader are a group.
3. Token-group matrix: the prefix shingles of each group are joined into the
   group's union. A class queries the groups that it shares a shingle with, unless
   links already connect it: the overlap with the union bounds the overlap with
   every member, and only qualifying groups are opened, that is, compared exactly
   with the class, blocks of members and queries at a time.
4. Connected components over all exact links.

Similarities are counted on whole sets of 64-bit hashes; equal sets are known by
a 64-bit digest. How frequent a shingle is, is read from a sketch: an array of
2 ** ``CELL_BITS`` counters, one for each value of a hash's first bits, summed over
all documents. What a cell holds above the mean tells its frequent shingles, the
clearer the more documents there are. It only fixes the order of 1, and any order
gives the same result.

Defined cases: texts without words have no shingles and link with nothing; texts
of fewer words than a shingle are one shingle of all their words; repeated rows
and equal texts share a class; a NULL id takes part but names no component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.llm.arrow_rows import slices
from talentscope.llm.common import bucket_count, discard, named, staged
from talentscope.llm.components import connected_components
from talentscope.llm.hashing import Spans, U, mix

SHINGLE = 5
BLOCK_SHINGLES = 1_500_000        # shingles of one packed block
BLOCK_CLASSES = 60_000            # so that two bytes number a block's classes
LEADERS = 3                       # leaders that a class is compared with for grouping
BUCKET_SHINGLES = 400_000         # prefix shingles of one bucket, about
CELL_BITS = 21                    # cells of the sketch, as a power of two
CHUNK_CELLS = 1 << 16             # cells of one row of partial counts
BLOCK_ROWS = 10_000               # documents of one slice at most
FAMILIAR = 4                      # prefix shingles shared with a leader to join its group
OPEN_CLASSES = 200                # classes of one side compared at once when a group is opened
MAX_BROADCAST_ROWS = 2_000_000    # of 16 bytes; more rows are joined by a shuffle

_FOLD = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c
              for c in range(256))
_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets per text)."""
    raw = [(t or "").encode().translate(_FOLD) for t in texts]
    flat = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    space = flat == 32
    edge = np.diff(space.astype(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    words = Spans(flat).hash(start, end)
    ends = np.cumsum([len(r) + 1 for r in raw])
    first = np.searchsorted(start, np.concatenate([[0], ends]) + 1)     # first word of each text
    n = np.diff(first)
    with np.errstate(over="ignore"):
        sums = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
        for j in range(k):
            sums += mix(words[j:len(words) - k + 1 + j] * _STEPS[j])
    doc = np.repeat(np.arange(len(texts)), n)
    whole = (np.flatnonzero(doc[:len(sums)] == doc[k - 1:k - 1 + len(sums)])
             if len(sums) else np.zeros(0, dtype=np.int64))
    h, owner = mix(sums[whole]), doc[whole]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        with np.errstate(over="ignore"):
            one = [mix(np.array([np.sum(mix(words[first[d]:first[d + 1]] * _STEPS[:n[d]]),
                                        dtype=np.uint64) + U(n[d])], dtype=np.uint64))[0]
                   for d in few.tolist()]
        h = np.concatenate([h, np.array(one, dtype=np.uint64)])
        owner = np.concatenate([owner, few])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def _class_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set (0 for an empty one)."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=np.uint64)])
        total = sums[offsets[1:]] - sums[offsets[:-1]]
        n = np.diff(offsets).astype(np.uint64)
    return np.where(n > 0, mix(total + n * _STEPS[7]), U(0)).view(np.int64)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-75 * n // 100) + 1


def _blocks(batches, text_at: int, k: int):
    """(batch rows, hashes, offsets) of bounded slices; several slices may be
    gathered by the caller up to ``BLOCK_SHINGLES``."""
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        for start, end in slices(texts):
            for s in range(start, end, BLOCK_ROWS):
                e = min(end, s + BLOCK_ROWS)
                yield batch.slice(s, e - s), *shingle_sets(texts[s:e], k)


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each hash: its first bits (``cells`` is a power of two)."""
    return (h >> U(65 - int(cells).bit_length())).astype(np.int64)


def _profile(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """Staged rows: (id, n shingles, class) per document, and per task the counts of
    the sketch's cells, compressed, in chunks (``chunk``, ``data``)."""
    src = docs.select(named(doc_id).cast("bigint").alias("id"), named(text).alias("text"))
    cells = 1 << CELL_BITS

    def run(batches):
        seen = np.zeros(cells, dtype=np.uint32)
        for part, h, offsets in _blocks(batches, 1, k):
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(_class_ids(h, offsets)),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            cell, times = np.unique(_cells(h, cells), return_counts=True)
            seen[cell] += times.astype(np.uint32)
        for i, at in enumerate(range(0, len(seen), CHUNK_CELLS)):
            counts = seen[at:at + CHUNK_CELLS]
            if counts.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, pa.array([i], pa.int32()), pa.array([_packed_counts(counts)])],
                    names=names)
    names = ["id", "n", "cls", "chunk", "data"]
    return staged(src.mapInArrow(run, "id bigint, n bigint, cls bigint, chunk int, data binary"),
                  "profile")


def _packed_counts(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype(np.uint64).tobytes(), codec="zstd", asbytes=True)


def _counts(data: bytes, cells: int) -> np.ndarray:
    size = min(CHUNK_CELLS, cells) * 8
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), dtype=np.uint64)


def _levels(profile: DataFrame, total: int) -> np.ndarray:
    """One byte per cell of the sketch: 0 for cells of the mean, growing with the
    logarithm of what they hold above it. Partial counts are summed in two steps."""
    cells = 1 << CELL_BITS
    mean = total / cells

    def summed(finish):
        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    sums[i] = sums[i] + _counts(data, cells) if i in sums else _counts(data, cells)
            for i, c in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([finish(c)])],
                                                 names=["chunk", "data"])
        return run

    def level(c: np.ndarray) -> bytes:
        above = np.maximum(0, c - mean) / (3 * np.sqrt(mean + 1))
        return np.floor(2 * np.log2(1 + above)).astype(np.uint8).tobytes()
    parts = profile.filter("chunk is not null").select("chunk", "data")
    first = parts.repartition("chunk", F.pmod(F.xxhash64("data"), F.lit(16))).mapInArrow(
        summed(_packed_counts), "chunk int, data binary")
    last = first.repartition("chunk").mapInArrow(summed(level), "chunk int, data binary")
    out = np.zeros(cells, dtype=np.uint8)
    for r in last.collect():                      # one byte per cell, whatever the input
        part = np.frombuffer(r["data"], dtype=np.uint8)
        out[r["chunk"] * CHUNK_CELLS:r["chunk"] * CHUNK_CELLS + len(part)] = part
    return out


def _spread_ids(spark: SparkSession, n: int) -> np.ndarray:
    """One int per partition number whose hash partition (of ``n``) is that number."""
    rows = (spark.range(40 * n + 100).select(
        F.col("id").cast("int").alias("id"),
        F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
        .groupBy("p").agg(F.min("id").alias("id")).collect())
    out = np.arange(n, dtype=np.int32)
    for r in rows:
        out[r["p"]] = r["id"]
    return out


def _packed_prefixes(docs: DataFrame, doc_id: str, text: str, k: int, levels, ids: np.ndarray):
    """Rows (bucket, data): the prefix shingles of a block's classes that fall into
    a bucket, with their places in the class's order, the classes and their sizes."""
    src = docs.select(named(doc_id).cast("bigint").alias("id"), named(text).alias("text"))
    n_buckets = len(ids)

    def run(batches):
        level = levels.value
        held = []
        size = 0

        def flush():
            cls = np.concatenate([c for c, _, _ in held])
            n = np.concatenate([np.diff(o) for _, _, o in held])
            h = np.concatenate([x for _, x, _ in held])
            _, first = np.unique(cls, return_index=True)
            chosen = np.zeros(len(cls), dtype=bool)
            chosen[first] = True
            chosen &= n > 0
            owner = np.repeat(np.arange(len(cls)), n)
            mine = chosen[owner]
            h, owner = h[mine], owner[mine]
            order = np.lexsort((h, level[_cells(h, len(level))], owner))
            h, owner = h[order], owner[order]
            counts = np.bincount(owner, minlength=len(cls))
            place = np.arange(len(h)) - (np.cumsum(counts) - counts)[owner]
            take = place < prefix_length(n)[owner]
            h, owner = h[take], owner[take]
            place = np.minimum(place[take] + 1, 65535)
            bucket = ((h >> U(40)) % U(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, owner, bucket, place = h[order], owner[order], bucket[order], place[order]
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
            out_b, out_d = [], []
            for b in range(n_buckets):
                s, e = cuts[b], cuts[b + 1]
                if s == e:
                    continue
                own, local = np.unique(owner[s:e], return_inverse=True)
                out_b.append(int(ids[b]))
                out_d.append(b"".join([
                    np.array([len(own), e - s], dtype=np.int64).tobytes(), cls[own].tobytes(),
                    n[own].astype(np.int64).tobytes(), h[s:e].tobytes(),
                    local.astype(np.uint16).tobytes(), place[s:e].astype(np.uint16).tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()),
                                              pa.array(out_d, pa.binary())],
                                             names=["bucket", "data"])
        for _, h, offsets in _blocks(batches, 1, k):
            held.append((_class_ids(h, offsets), h, offsets))
            size += len(h)
            if size >= BLOCK_SHINGLES or sum(len(c) for c, _, _ in held) >= BLOCK_CLASSES - BLOCK_ROWS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()
    return src.mapInArrow(run, "bucket int, data binary").repartition(n_buckets, "bucket")


def _unpack(data: bytes):
    m, k = np.frombuffer(data, dtype=np.int64, count=2).tolist()
    cls = np.frombuffer(data, np.int64, m, 16)
    n = np.frombuffer(data, np.int64, m, 16 + 8 * m)
    h = np.frombuffer(data, np.uint64, k, 16 + 16 * m)
    local = np.frombuffer(data, np.uint16, k, 16 + 16 * m + 8 * k)
    place = np.frombuffer(data, np.uint16, k, 16 + 16 * m + 10 * k)
    return h, cls[local], n[local], place.astype(np.int64)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True where any of the (sorted) keys differs from the entry before."""
    out = np.ones(len(keys[0]), dtype=bool)
    out[1:] = False
    for x in keys:
        out[1:] |= x[1:] != x[:-1]
    return out


def _several(h: np.ndarray) -> np.ndarray:
    """True for the entries of a sorted array whose value occurs more than once."""
    if not len(h):
        return np.zeros(0, dtype=bool)
    sizes = np.diff(np.append(np.flatnonzero(_firsts(h)), len(h)))
    return np.repeat(sizes > 1, sizes)


def _leaders(packed: DataFrame) -> DataFrame:
    """Staged rows: kind 0 (a class, b leader, sizes, shared prefix shingles) and
    kind 1 (a class, b shingle, na size, nb place) for shingles of several classes."""
    def run(batches):
        parts = [_unpack(d.as_py()) for batch in batches for d in batch.column(1)]
        if not parts:
            return
        h, cls, n, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, cls, n, place = h[order], cls[order], n[order], place[order]
        keep = _several(h)
        h, cls, n, place = h[keep], cls[keep], n[keep], place[keep]
        order = np.lexsort((cls, h))
        h, cls, n, place = h[order], cls[order], n[order], place[order]
        keep = _firsts(h, cls) if len(h) else keep[:0]
        h, cls, n, place = h[keep], cls[keep], n[keep], place[keep]
        keep = _several(h)
        h, cls, n, place = h[keep], cls[keep], n[keep], place[keep]
        if not len(h):
            return
        yield _pairs(1, cls, h.view(np.int64), n, place, np.zeros_like(n))
        band = np.floor(np.log(n) / np.log(4 / 3) + 1e-9).astype(np.int64)
        order = np.lexsort((mix(cls.view(np.uint64)), band, h))
        h, cls, n, band = h[order], cls[order], n[order], band[order]
        group = np.cumsum(_firsts(h, band)) - 1
        lead = np.flatnonzero(_firsts(h, band))
        near = np.zeros(len(lead), dtype=bool)          # the group before: same shingle, next band
        near[1:] = (h[lead[1:]] == h[lead[:-1]]) & (band[lead[1:]] == band[lead[:-1]] + 1)
        a, b = [np.arange(len(h))], [lead[group]]
        down = np.flatnonzero(near[group])
        a.append(down)
        b.append(lead[group[down] - 1])
        after = np.append(near[1:], False)
        up = np.flatnonzero(after[group])
        a.append(up)
        b.append(lead[group[up] + 1])
        a, b = np.concatenate(a), np.concatenate(b)
        ok = (cls[a] != cls[b]) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        order = np.lexsort((cls[b], cls[a]))
        a, b = a[order], b[order]
        first = np.flatnonzero(_firsts(cls[a], cls[b])) if len(a) else np.zeros(0, dtype=np.int64)
        shared = np.diff(np.append(first, len(a)))
        yield _pairs(0, cls[a[first]], cls[b[first]], n[a[first]], n[b[first]], shared)
    schema = "kind int, a bigint, b bigint, na bigint, nb bigint, shared bigint"
    return staged(packed.mapInArrow(run, schema), "leaders")


def _pairs(kind, a, b, na, nb, shared) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, dtype=np.int32)), *[
            pa.array(np.ascontiguousarray(x, dtype=np.int64)) for x in (a, b, na, nb, shared)]],
        names=["kind", "a", "b", "na", "nb", "shared"])


def _tail(n):
    """Shingles of a set of ``n`` beyond its prefix."""
    return F.ceil(n * 75 / 100) - 1


def _needed(na, nb):
    """The least overlap of linked sets of these sizes: 100 i >= 75 (na + nb - i)."""
    return F.ceil((na + nb) * 3 / F.lit(7) - F.lit(1e-9))


def _bodies(docs: DataFrame, doc_id: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """One staged text per wanted (cls, rep): a row of that id whose set is the
    class. The ids are broadcast only after they are counted; more of them are
    joined by a shuffle."""
    src = docs.select(named(doc_id).cast("bigint").alias("id"), named(text).alias("text"))
    ids = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_ROWS else wanted

    def run(batches):
        for part, h, offsets in _blocks(batches, 1, k):
            own = pa.array(_class_ids(h, offsets) == part.column(0).to_numpy())
            yield part.filter(own)
    found = src.join(ids, src["id"].eqNullSafe(ids["rep"])).select("cls", "text")
    return staged(found.mapInArrow(run, "cls bigint, text string").dropDuplicates(["cls"]),
                  "bodies")


def _linked(docs: DataFrame, doc_id: str, text: str, k: int, pairs: DataFrame,
            classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity, staged."""
    pairs = staged(pairs.select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = staged(classes.join(wanted, "cls").select("cls", "rep"), "wanted")
    bodies = _bodies(docs, doc_id, text, k, wanted)

    def run(batches):
        for batch in batches:
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = []
            for s, e in slices([x + y for x, y in zip(ta, tb)]):
                both = list(dict.fromkeys(ta[s:e] + tb[s:e]))
                at = {t: i for i, t in enumerate(both)}
                h, o = shingle_sets(both, k)
                for x, y in zip(ta[s:e], tb[s:e]):
                    i, j = at[x], at[y]
                    p, q = h[o[i]:o[i + 1]], h[o[j]:o[j + 1]]
                    met = np.sort(np.concatenate([p, q]))
                    both_in = int((met[1:] == met[:-1]).sum())
                    ok.append(100 * both_in >= 75 * (len(p) + len(q) - both_in))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)],
                                             names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    full = (pairs.join(bodies.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
            .join(bodies.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b"))
    links = staged(full.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint"), "links")
    discard(pairs, wanted, bodies)
    return links


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   k: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``: component_id is the
    smallest id reachable by links, the row's own included."""
    return _grouped_rows(docs, doc_id, text, k).drop("cls")


def _grouped_rows(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """``similar_groups`` with the digest of each row's set (``cls``)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    profile = _profile(docs, doc_id, text, k)
    rows = profile.filter("chunk is null").select("id", "n", "cls")
    total = rows.agg(F.sum("n").alias("n")).first()
    levels = sc.broadcast(_levels(profile, total["n"] or 0))
    ids = _spread_ids(spark, bucket_count(spark, (total["n"] or 0) / 4, BUCKET_SHINGLES))
    found = _leaders(_packed_prefixes(docs, doc_id, text, k, levels, ids))
    classes = staged(rows.filter("n > 0").groupBy("cls").agg(
        F.min("id").alias("rep"), F.first("n").alias("n")), "classes")

    na, nb = F.col("na"), F.col("nb")
    # the few leaders that share most (of at most three per prefix shingle)
    best = F.slice(F.sort_array(F.collect_list(F.struct("shared", "b", "able")), asc=False),
                   1, LEADERS)
    able = F.col("shared") + F.greatest(_tail(na), _tail(nb)) >= _needed(na, nb)
    stars = (found.filter("kind = 0").groupBy("a", "b", "na", "nb")
             .agg(F.sum("shared").alias("shared")).withColumn("able", able)
             .groupBy("a").agg(best.alias("best")))
    stars = staged(stars.select("a", "best", F.when(F.col("best")[0]["shared"] >= FAMILIAR,
                                                    F.col("best")[0]["b"]).alias("lead")), "leaders")
    asked = stars.select("a", F.explode(F.filter("best", lambda x: x["able"])).alias("x")).select(
        "a", F.col("x.b").alias("b"))
    lists = found.filter("kind = 1").select(F.col("a").alias("cls"), F.col("b").alias("token"),
                                            F.col("na").alias("n"), F.col("nb").alias("place"))
    links = _linked(docs, doc_id, text, k, asked, classes)
    linked = connected_components(links)                       # (node, component)
    named = classes.join(linked, classes["cls"] == linked["node"], "left").join(
        stars.select(F.col("a").alias("cls"), "lead"), "cls", "left")
    named = staged(named.select("cls", "n", F.coalesce("component", "cls").alias("comp"),
                                F.coalesce("lead", "cls").alias("grp")), "groups")
    single, several, overlap = _open_groups(lists, named, ids)
    discard(found)
    links = links.unionByName(_linked(docs, doc_id, text, k, single, classes)).unionByName(
        _opened(docs, doc_id, text, k, several, named, classes))
    discard(overlap, several)
    groups = connected_components(links)

    comp = classes.join(groups, classes["cls"] == groups["node"], "left").select(
        "cls", "rep", F.coalesce("component", "cls").alias("component"))
    least = comp.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = comp.join(least, "component").select("cls", "component_id")
    return rows.join(named, "cls", "left").select(
        "cls", "id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias(
            "component_id"))


def _open_groups(lists: DataFrame, named: DataFrame,
                 ids: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is still to compare, where the bound leaves room for a link: pairs (a, b)
    of a class and a group of one, and (a, grp, members) of a class and a group; and
    the staged overlaps that the pairs are read from.

    ``named`` has (cls, n, comp, grp): the component found so far and the group (the
    classes that share most with the same leader, linked or not). A class queries
    every group, its own too, that shares a prefix shingle with it through a class
    of a larger component (ties by number): pairs inside a component are settled,
    and each other pair is asked from one side. The shared shingles with the
    group's union, plus what may lie beyond the prefixes, must reach the least
    overlap that any size allowed by both sides needs. Against a group of one the
    bound is sharper: after the last shared prefix shingle neither side can share
    more than it has left, and beyond the prefix that ends first no more than that
    class has beyond its prefix."""
    stats = named.groupBy("grp").agg(F.count("*").alias("members"), F.min("n").alias("lo"),
                                     F.max("n").alias("hi"))
    weight = named.groupBy("comp").agg(F.count("*").alias("weight"))
    known = (named.join(weight, "comp").join(stats, "grp")
             .select("cls", "grp", "members", "lo", "hi", "comp", "weight"))
    g = lists.join(known, "cls")
    mixed = (g.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
             .filter("x <> y").select("token"))
    n_buckets = len(ids)
    bucket = F.element_at(F.array(*[F.lit(int(i)) for i in ids]),
                          (F.pmod(F.xxhash64("token"), F.lit(n_buckets)) + 1).cast("int"))
    rows = (g.join(mixed, "token")
            .select(bucket.alias("bucket"), "token", "cls", "grp", "members", "n", "place",
                    "comp", "weight", "lo", "hi")
            .repartition(n_buckets, "bucket"))

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        columns = [t.column(i).to_numpy() for i in range(1, 11)]
        order = np.lexsort((columns[1], columns[6], columns[7], columns[2], columns[0]))
        token, cls, grp, members, n, place, comp, weight, lo, hi = (x[order] for x in columns)
        starts = np.append(np.flatnonzero(_firsts(token)), len(token))
        qs, gs = [], []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            tails = np.append(np.flatnonzero(_firsts(grp[s:e]))[1:], e - s) + s - 1
            for i in tails.tolist():             # the group's class of the largest component
                q = (weight[s:e] < weight[i]) | ((weight[s:e] == weight[i])
                                                 & (comp[s:e] < comp[i]))
                # some member's size must allow a link
                q &= (4 * n[s:e] >= 3 * lo[i]) & (3 * n[s:e] <= 4 * hi[i])
                q = np.flatnonzero(q) + s
                qs.append(q)
                gs.append(np.full(len(q), i))
        q, at = np.concatenate(qs), np.concatenate(gs)
        if not len(q):
            return
        order = np.lexsort((grp[at], cls[q]))
        q, at = q[order], at[order]
        first = np.flatnonzero(_firsts(cls[q], grp[at]))
        f, one = first, members[at[first]] == 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(cls[q[f]]), pa.array(n[q[f]]), pa.array(grp[at[f]]),
             pa.array(cls[at[f]], mask=~one), pa.array(n[at[f]], mask=~one),
             pa.array(np.diff(np.append(f, len(q)))),
             pa.array(np.maximum.reduceat(place[q], f)), pa.array(np.maximum.reduceat(place[at], f))],
            names=["a", "na", "grp", "b", "nb", "shared", "pa", "pb"])
    schema = ("a bigint, na bigint, grp bigint, b bigint, nb bigint, shared bigint, pa bigint, "
              "pb bigint")
    overlap = staged(rows.mapInArrow(run, schema).groupBy("a", "na", "grp", "b", "nb").agg(
        F.sum("shared").alias("shared"), F.max("pa").alias("pa"), F.max("pb").alias("pb")), "overlap")
    na, nb, shared = F.col("na"), F.col("nb"), F.col("shared")
    beyond = F.greatest(F.least(_tail(na), nb - F.col("pb")), F.least(_tail(nb), na - F.col("pa")))
    single = overlap.filter(F.col("b").isNotNull() & (shared + beyond >= _needed(na, nb)))
    least = F.greatest(F.col("lo"), F.ceil(na * 3 / 4))
    most = F.least(F.col("hi"), F.floor(na * 4 / 3))
    several = (overlap.filter(F.col("b").isNull()).select("a", "na", "grp", "shared")
               .join(stats, "grp").filter(least <= most)
               .filter(shared + F.greatest(_tail(na), _tail(most)) >= _needed(na, least))
               .select("a", "grp", "members"))
    return single.select("a", "b"), staged(several, "qualifying"), overlap


def _opened(docs: DataFrame, doc_id: str, text: str, k: int, several: DataFrame,
            named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of classes a and the members of their qualifying groups, staged:
    one for every component that a links with.

    Members and queries of a group are packed into blocks of about
    ``OPEN_CLASSES`` texts; each pair of blocks is one task row, in which every
    query is counted against all members at once."""
    members = named.select("cls", "comp", "grp").join(
        several.select("grp", "members").distinct(), "grp")
    wanted = members.select("cls").union(several.select("a")).distinct()
    wanted = staged(classes.join(wanted, "cls").select("cls", "rep"), "wanted")
    bodies = _bodies(docs, doc_id, text, k, wanted)

    def packed(df, count, out):
        slot = F.pmod(F.xxhash64("cls"), F.ceil(F.col(count) / OPEN_CLASSES))
        return (df.join(bodies, "cls").groupBy("grp", slot.alias("slot"))
                .agg(F.collect_list(F.struct("cls", "comp", "text")).alias(out)).drop("slot"))
    asked = several.groupBy("grp").agg(F.count("*").alias("queries"))
    queries = several.select("grp", F.col("a").alias("cls")).join(asked, "grp").join(
        named.select("cls", "comp"), "cls")
    pairs = packed(queries, "queries", "qs").join(packed(members, "members", "ms"), "grp")

    def run(batches):
        for batch in batches:
            for qs, ms in zip(batch.column(0), batch.column(1)):
                qs, ms = qs.as_py(), ms.as_py()
                h, o = shingle_sets([m["text"] for m in ms], k)
                owner, n = np.repeat(np.arange(len(ms)), np.diff(o)), np.diff(o)
                comp = np.array([m["comp"] for m in ms])
                hq, oq = shingle_sets([q["text"] for q in qs], k)
                a, b = [], []
                for i, q in enumerate(qs):
                    own = hq[oq[i]:oq[i + 1]]
                    at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                    met = np.bincount(owner[own[at] == h], minlength=len(ms))
                    link = np.flatnonzero((100 * met >= 75 * (n + len(own) - met))
                                          & (comp != q["comp"]))
                    for j in np.unique(comp[link], return_index=True)[1].tolist():
                        a.append(q["cls"])
                        b.append(ms[link[j]]["cls"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                 names=["a", "b"])
    links = staged(pairs.select("qs", "ms").mapInArrow(run, "a bigint, b bigint"), "links")
    discard(wanted, bodies)
    return links


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       k: int = SHINGLE) -> DataFrame:
    """``docs`` with only the document of smallest id of every group of similar
    documents (documents without words and without an id all stay; of repeated
    rows with the same id, all stay that are not similar to a smaller id)."""
    found = staged(_grouped_rows(docs, doc_id, text, k).filter("id is not null").select(
        "id", "cls", F.coalesce(F.col("component_id") != F.col("id"), F.lit(False)).alias("copied"))
        .groupBy("id", "cls").agg(F.bool_or("copied").alias("copied")), "copied")
    ids = found.groupBy("id").agg(F.bool_and("copied").alias("whole"),
                                  F.bool_or("copied").alias("some")).filter("some")
    mixed = staged(ids.filter(~F.col("whole")).select(F.col("id").alias("mixed")), "mixed")
    gone = found.filter("copied").select(F.col("id").alias("gone"), F.col("cls").alias("gone_cls"))
    rows = docs.select(F.struct("*").alias("row"), named(doc_id).alias("id"), named(text).alias("text"))
    rest = rows.join(gone.select("gone").distinct(), F.col("id") == F.col("gone"), "left_anti").select("row")
    if mixed.isEmpty():
        return rest.select("row.*")

    # ids with copied and other texts: only the rows of a copied class go
    part = rows.join(mixed, F.col("id") == F.col("mixed")).select(
        "row", F.col("mixed").alias("id"), "text")

    def run(batches):
        for piece, h, offsets in _blocks(batches, 2, k):
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(_class_ids(h, offsets))],
                names=["row", "id", "cls"])
    schema = part.select("row", "id", F.lit(0).cast("bigint").alias("cls")).schema
    stays = part.mapInArrow(run, schema).join(
        gone, (F.col("id") == F.col("gone")) & (F.col("cls") == F.col("gone_cls")), "left_anti")
    return rest.union(stays.select("row")).select("row.*")
