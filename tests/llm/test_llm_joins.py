"""Operators that exchange data between documents, against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from talentscope.llm import hashing
from talentscope.llm import ngram_join as N
from talentscope.llm import suffix_dedup as X
from talentscope.llm import warc as W
from talentscope.llm.components import connected_components
from talentscope.llm.suffix_sort import deep_shallow


# --- n-gram join ------------------------------------------------------------

def _sets(rows):
    out = []
    for _, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        out.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)})
    return out


def _components(rows):
    sets, up = _sets(rows), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            x = len(s & t)
            if x and 100 * x >= 75 * (len(s) + len(t) - x):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return sorted(((d, len(sets[i]), ids.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def _near_copies(seed, n):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(30)]
    base = [[r.choice(v) for _ in range(r.randint(3, 60))] for _ in range(10)]
    line = [r.choice(v) for _ in range(25)]
    rows = []
    for i in range(n):
        b = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            b[r.randrange(len(b))] = r.choice(v)
        x = r.random()
        b = b + line if x < .2 else line + b[:r.randint(0, 9)] if x < .3 else b
        b = [r.choice(v[:4]) for _ in range(r.randint(0, 9))] if r.random() < .05 else b
        rows.append((i, " ".join(b)))
    return rows


@pytest.mark.parametrize("bits", [2, 21])
def test_components_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(N, "CELL_BITS", bits)
    rows = _near_copies(5, 350) + [(701, None), (702, ""), (703, " \n"), (None, "lone words"),
                                   (3, "A b"), (3, "a B"), (4, "other words of a repeated id")]
    got = N.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == _components(rows)


def test_open_groups_finds_links_between_groups(spark):
    """Two stars whose leaders do not link, but a member of each does."""
    w = [f"t{i}" for i in range(130)]
    rows = [(i, " ".join(w[s:s + 90])) for i, s in enumerate((0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40))]
    got = N.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == _components(rows)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(2, text), (1, text + " end"), (5, None), (5, None), (7, "a b"), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    out = N.keep_one_per_group(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 5, 5, 7, None]
    assert N.keep_one_per_group(df.limit(0)).count() == 0


def test_keep_one_by_row(spark):
    """An id with a copied and a unique text loses only the copied row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a, 0), (5, a + " end", 1), (5, b, 2), (5, "", 3), (5, None, 4), (5, a + " END", 5),
            (7, b + " end", 6), (8, a, 7), (8, a + " end", 8), (9, c, 9), (9, c, 10), (None, a, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    out = N.keep_one_per_group(df)
    assert out.schema == df.schema
    assert sorted(r["at"] for r in out.collect()) == [0, 2, 3, 4, 9, 10, 11]


def test_long_paths_of_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}


# --- suffix dedup -----------------------------------------------------------

def test_windows_beyond_26_bits(monkeypatch):
    """Equal hashes everywhere: every window takes its leftmost position."""
    n = (1 << 26) + 100_000
    monkeypatch.setattr(hashing, "_inverses", np.broadcast_to(np.uint64(1), n))
    spans = hashing.Spans.__new__(hashing.Spans)
    spans.prefix = np.broadcast_to(np.uint64(0), n)
    got = spans.least_in_windows(16, 35)
    assert len(got) == n - 50
    assert (got[-200_000:] == np.arange(n - 50 - 200_000, n - 50)).all()


def test_windows_in_chunks():
    raw = np.frombuffer(random.Random(6).randbytes(3000), np.uint8) % 3
    spans = hashing.Spans(raw)
    want = spans.least_in_windows(8, 43)
    assert len(want) == 2951 and len(set(want.tolist())) > 50
    for chunk in (1, 64, 1000):
        assert (spans.least_in_windows(8, 43, chunk) == want).all()
    assert all(k <= w < k + 43 for k, w in enumerate(want.tolist()))


def test_deep_shallow_orders():
    r = random.Random(3)
    for _ in range(150):
        raw = np.frombuffer(bytes(r.choice(b"ab" if r.random() < .5 else b"abcdefgh")
                                  for _ in range(r.randint(60, 300))), np.uint8)
        raw = np.concatenate([raw] * r.choice([1, 3]))
        depth = r.choice([30, 50])
        starts = np.array(sorted(r.sample(range(len(raw) - depth + 1),
                                          min(len(raw) - depth + 1, r.randint(0, 60)))), dtype=np.int64)
        order, group = deep_shallow(raw, starts, depth)
        s = [raw[x:x + depth].tobytes() for x in starts]
        names = sorted(set(s))
        assert [s[i] for i in order] == sorted(s)
        assert group.tolist() == [names.index(s[i]) for i in order]


def _cut(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1 if i is not None else 0):
            first[b[s:s + length]] = min(first.get(b[s:s + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        c = [0] * len(b)
        for s in range(len(b) - length + 1 if i is not None else 0):
            if first[b[s:s + length]] < i:
                c[s:s + length] = [1] * length
        spans = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
        kept = bytes(x for x, y in zip(b, c) if not y)
        out.append((i, len(b), sum(c), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _repeats(seed, n):
    r = random.Random(seed)
    v = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(60)]

    def text(k):
        return " ".join(r.choice(v) for _ in range(k))
    base, passages = [text(r.randint(5, 120)) for _ in range(10)], [text(15) for _ in range(5)]
    rows = []
    for i in range(n):
        x = r.random()
        if x < .35:
            w = r.choice(base).split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(v)
            t = " ".join(w)
        elif x < .6:
            t = f"{text(r.randint(0, 30))} {r.choice(passages)} {text(r.randint(0, 30))}"
        else:
            t = ("ab " * r.randint(0, 60) if x < .65 else "z" * r.randint(0, 150) if x < .7
                 else None if x < .72 else r.choice(base) + r.choice(base) if x < .75
                 else text(r.randint(0, 60)))
        rows.append((i if r.random() > .02 else None, t))
    rows += rows[:5] + [(7, "q" * 60), (3, "q" * 70), (9, "é" * 40)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,many", [(1, 16), (2, 2)])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, seed, many):
    monkeypatch.setattr(X, "BLOCK_BYTES", 9000)
    rows = _repeats(seed, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    # the settings above are read on the driver and sent with the functions
    got = X.repeated_bytes(df)
    assert sorted(map(tuple, got.collect()), key=str) == _cut(rows)


def test_dedup_keeps_columns_and_characters(spark):
    rows = [(1, "é" * 60, 60, "x"), (2, "aé" + "é" * 60 + "b", 63, None), (3, "é" * 60, 60, "y"),
            (4, None, None, "z"), (5, "", 0, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, kind string")
    got = {r["doc_id"]: tuple(r)[1:] for r in X.dedup(df).collect()}
    assert got == {1: ("é" * 60, 60, "x"), 2: ("ab", 2, None), 4: (None, None, "z"), 5: ("", 0, "e")}
    assert X.dedup(df).schema == df.schema
    assert X.dedup(df.limit(0)).count() == 0


# --- WARC -------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x y", "h" * 200), (2, None, "h" * 200), (2, "u://\r\nx", "h" * 200),
            (3, "k", None), (None, "z", "h" * 200), (0, "né", "WARC/1.0\r\n\r\n<é>" * 20), (4, "", "s"),
            (5, "v", "s"), (6, "w", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, W.page_captures(pages).collect()), key=str)

    def want(i, h):
        b = (h or "").encode()
        again = i == 2
        return (i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response",
                1 if again else None)
    assert got == sorted((want(i, h) for i, _, h in rows), key=str)
    path = W.write_archives(pages, str(tmp_path / "warc"))
    caps = W.assemble(W.read_archives(spark, path)).collect()
    assert len(caps) == len(rows)
    for c in caps:
        assert c["request"]["type"] == "request"
        assert c["metadata"] is not None
        if c["response"]["type"] == "response":
            digest = hashlib.sha256(bytes(c["response"]["payload"])).hexdigest()
            assert c["response"]["declared_digest"] == f"sha256:{digest}"
    assert W.page_captures(pages.limit(0)).count() == 0


def test_warc_incomplete_transaction(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string")
    found = W.read_archives(spark, W.write_archives(pages, str(tmp_path / "w")))
    alone = W.assemble(found.filter("type <> 'response'")).first()
    assert alone["response"] is None and alone["request"]["head"].startswith("GET / ")


def test_warc_members_and_plain_files():
    import gzip
    record = (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 30\r\n\r\n"
              b"HTTP/1.1 200 OK\r\n\r\n0123456789a\r\n\r\n")
    for content in (record * 2, gzip.compress(record) + gzip.compress(record)):
        assert [(b[-11:], e) for _, b, e in W.parse(content)] == [(b"0123456789a", None)] * 2


def _warc(kind, record_id, block, *more, length=None):
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID:<{record_id}>", *more]
    if length != "":
        head.append(f"Content-Length:  {len(block) if length is None else length}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\n\r\n"


def test_warc_chained_and_repeated_concurrent_to(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(
        _warc("metadata", "m1", b"pageId: 7", "WARC-Concurrent-To: <q1>")
        + _warc("request", "q1", b"GET / HTTP/1.1", "WARC-Concurrent-To: <r1>")
        + _warc("response", "r1", HTTP + b"one WARC/1.0\r\nWARC/1.1\r\n\r\n")
        + _warc("response", "r2", HTTP + b"two", "WARC-Target-URI: http://b/")
        + _warc("metadata", "m2", b"both", "WARC-Concurrent-To: <r2>", "warc-concurrent-to: <r3>")
        + _warc("revisit", "r3", HTTP, "WARC-Refers-To: <r2>", "WARC-Payload-Digest: sha256:ab")
        + _warc("metadata", "x1", b"", "WARC-Concurrent-To: <x2>")            # a circle
        + _warc("metadata", "x2", b"", "WARC-Concurrent-To: <x1>"))
    caps = {c["capture_id"]: c for c in W.assemble(W.read_archives(spark, str(tmp_path))).collect()}
    assert set(caps) == {"r1", "r2", "r3"}
    assert (caps["r1"]["request"]["record_id"], caps["r1"]["metadata"]["record_id"]) == ("q1", "m1")
    assert bytes(caps["r1"]["response"]["payload"]).startswith(b"one WARC/1.0")
    assert caps["r2"]["metadata"]["head"] == caps["r3"]["metadata"]["head"] == "both"
    assert (caps["r3"]["response"]["refers_to"], caps["r3"]["response"]["payload_digest"]) == ("r2", "ab")


def test_warc_bad_records_do_not_end_the_job(spark, tmp_path):
    import gzip
    good = _warc("response", "r1", HTTP + b"one")
    (tmp_path / "a.warc").write_bytes(
        good + b"some WARC/1. text\r\n" + _warc("response", "r2", b"no length\r\n", length="")
        + _warc("response", "r3", HTTP + b"x", length="-5") + _warc("response", "r4", HTTP + b"four")
        + _warc("response", "r5", HTTP + b"cut", length=4000))
    (tmp_path / "b.warc.gz").write_bytes(
        gzip.compress(good.replace(b"r1", b"g1")) + gzip.compress(good * 50)[:40])
    (tmp_path / "c.warc.gz").write_bytes(
        gzip.compress(good.replace(b"r1", b"g2")) + b"\x1f\x8bnot gzip at all")
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response")
    found = W.read_archives(spark, str(tmp_path)).cache()
    errors = sorted((r["record_id"] or "", r["error"]) for r in found.collect() if r["error"])
    assert [e for e in errors if "text" not in e[1]] == [
        ("", "damaged gzip member"), ("", "gzip member without its end"), ("", "header without an end"),
        ("r2", "no content length"), ("r3", "no content length"), ("r5", "truncated")]
    assert sum("text" in e for _, e in errors) >= 3      # between records, and of blocks without a length
    got = sorted(c["capture_id"] for c in W.assemble(found).collect())
    found.unpersist()
    assert got == ["g1", "g2", "r1", "r4"]


# --- pipeline ---------------------------------------------------------------

def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as C
    import public_tokenizers
    import sentencepiece

    from talentscope.llm import decontaminate as D
    from talentscope.llm import quality_rules as Q

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = Q.filter_quality(docs).toPandas()
    rows = list(zip(kept.doc_id.tolist(), kept.text.tolist()))
    stays = [(i, t) for (i, t) in rows if dict((a, c) for a, _, c in _components(rows))[i] == i]
    length, first, cut = 50, {}, []
    for i, t in sorted(stays):
        b = t.encode()
        c = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first.setdefault(b[s:s + length], i) < i:
                c[s:s + length] = True
        if c.any():
            t = b"".join(x.encode() for x, g in zip(t, _per_char(t, c)) if not g).decode()
        if t.strip() or not c.any():
            cut.append((i, t))
    bench = pd.read_parquet(f"{SF_SMALL}/benchmark.parquet")
    auto = D.Automaton([(str(i), D.words_of(t)) for i, t in zip(bench.item_id, bench.text)])
    final = []
    for i, t in cut:
        n, spans, _ = D.scan(auto, [t])[0]
        if sum(e - s for s, e in spans) <= D.MAX_COVERAGE * n:
            final.append((i, D.cut_words(t, spans) if spans else t))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (t, sp.encode(t)) for i, t in final}
    out = C.run(spark, SF_SMALL)
    assert out.columns == [*docs.columns, "ids", "n_tokens"]
    got = {r["doc_id"]: (r["text"], r["ids"]) for r in out.collect()}
    assert got == want
    assert out.filter("n_tokens <> size(ids) or n_chars <> length(text)").count() == 0


def _per_char(text, covered):
    at, out = 0, []
    for c in text:
        n = len(c.encode())
        out.append(bool(covered[at:at + n].any()))
        at += n
    return out


def test_pipeline_leaves_only_its_result(spark):
    """Folders and catalogue tables of the stages are gone after a run."""
    import corpus_pipeline as C
    from talentscope.session import checkpoint_dir, folder_names

    def left():
        return ({n for n in folder_names(spark, checkpoint_dir(spark)) if n.startswith("llm-")},
                {t.name for t in spark.catalog.listTables()})
    folders, tables = left()
    out = C.run(spark, SF_SMALL)
    more, now = left()
    assert now == tables and {n.split("-")[1] for n in more - folders} == {"stage4"}
    assert out.count() > 0


def test_a_stage_keeps_what_its_input_reads(spark):
    """An input that is not written yet still reads the folders of the stage before."""
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    first = C.quality_stage(spark, docs, SF_SMALL)
    second = C.near_duplicate_stage(spark, first, SF_SMALL)
    assert 0 < second.count() <= first.count()


def test_sketch_levels_tell_frequent_shingles(spark):
    """Counts of all partitions add up; frequent shingles come last in the order."""
    often = " ".join(f"a{i}" for i in range(30))
    rows = [(i, often + " " + " ".join(f"x{i}y{j}" for j in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    profile = N._profile(docs, "doc_id", "text", 5)
    levels = N._levels(profile, profile.agg(F.sum("n")).first()[0])
    h, o = N.shingle_sets([often] + [t for _, t in rows[:20]])
    level = levels[N._cells(h, len(levels))]
    common = np.isin(h, h[:o[1]])
    assert level[common].min() > np.quantile(level[~common], 0.99)
