"""License scan, ranked search and token alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from talentscope.llm import license_scan as C
from talentscope.llm import token_alignment as A
from talentscope.llm import trie_search as T
from talentscope.llm.license_rules import BASE, RULES

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


# --- ranked search ----------------------------------------------------------

def ranked(docs, items, k=10):
    counted = [(d, Counter(words_of(t)), len(words_of(t))) for d, t in docs if words_of(t)]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for i, t in items:
        found = []
        for d, c, size in counted:
            m = 25 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                        * ((10 ** 9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words_of(t) if c[w])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        found.sort(key=lambda x: x[:3])
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(found[:k])]
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(r.choice(v[:r.randint(3, 40)]) for _ in range(r.randint(0, 30))))
            for i in range(300)]
    docs += [(500, None), (501, ""), (None, "w1 w2 W3"), (7, "w1 w1"), (502, "?!")]
    docs += [(600 + i, "w1 w39 w5 w39") for i in range(40)]        # more copies than places
    items = [(i, " ".join(r.choice(v) for _ in range(r.randint(0, 12)))) for i in range(20)]
    return docs, items + [(3, "zzz"), (None, "w1 w1 w39"), (50, None), (0, "w2"), (51, "W39, w5")]


def found(spark, docs, items, parts=3):
    got = T.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts),
                   spark.createDataFrame(items, "item_id long, text string"))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    assert found(spark, docs, items) == ranked(docs, items)


def test_search_in_small_blocks(spark, monkeypatch):
    """Several vocabulary blocks, several tries a task."""
    docs, items = corpus(3)
    for name, value in (("BLOCK_BYTES", 150), ("CELLS", 900)):
        monkeypatch.setattr(T, name, value)
    assert found(spark, docs, items, 2) == ranked(docs, items)


@pytest.mark.parametrize("leaf", [1, 4])
def test_trie_leaves_subtrees_out(monkeypatch, leaf):
    """The bounds spare most exact scores, and the result is that of all scores."""
    monkeypatch.setattr(T, "LEAF", leaf)
    r = np.random.default_rng(5)
    n, terms, k = 4000, 400, 10
    topic = r.integers(0, 8, n)                        # documents of a topic share rare terms
    sets = [np.unique(np.concatenate([t * 45 + np.minimum(r.geometric(.15, r.integers(0, 12)), 45) - 1,
                                      r.integers(360, terms, r.integers(0, 9))])) for t in topic]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rank = np.concatenate(sets).astype(np.int64)
    tf, m = r.integers(1, 4, len(rank)), r.integers(25, 400, n)
    weights = r.integers(5, 9000, terms)
    trie = T.Trie(offsets, rank, tf, m, np.arange(n), k)
    dense = np.zeros((n, terms), dtype=np.int64)
    dense[np.repeat(np.arange(n), np.diff(offsets)), rank] = T.term_value(
        weights[rank], tf, np.repeat(m, np.diff(offsets)))
    scored = 0
    for i in range(16):
        own = np.unique(np.concatenate([i % 8 * 45 + r.integers(0, 45, 9), r.integers(360, terms, 4)]))
        group = T.ItemGroup([(0, own, np.ones(len(own), dtype=np.int64))], weights, k)
        _, columns, weight, best = group.items[0]
        scored += trie.search(trie.table(group.ranks, terms), columns, weight, best)
        s = dense[:, own].sum(axis=1)
        want = sorted(range(n), key=lambda d: (-s[d], d))[:k]
        assert list(zip(best.id, best.score)) == [(d, s[d]) for d in want if s[d] > 0]
    assert scored < 0.3 * n * 16


def test_items_in_small_groups(monkeypatch):
    """However the items are grouped, each finds the same documents."""
    r = np.random.default_rng(2)
    found = [(i, [b"t%d" % t for t in r.integers(0, 50, r.integers(1, 9))]) for i in range(30)]
    number = {b"t%d" % t: t for t in range(50)}
    offsets = np.arange(0, 601, 6)
    rank = np.concatenate([np.sort(r.choice(50, 6, replace=False)) for _ in range(100)])
    trie = T.Trie(offsets, rank, r.integers(1, 5, 600), r.integers(25, 99, 100), np.arange(100), 5)
    results = []
    for terms in (1 << 12, 12, 1):
        monkeypatch.setattr(T, "GROUP_TERMS", terms)
        groups = T._item_groups(found, number, np.arange(50), np.arange(50) * 7, 5)
        for g in groups:
            table = trie.table(g.ranks, 50)
            for _, columns, weight, best in g.items:
                trie.search(table, columns, weight, best)
        results.append([(i, b.id.tolist(), b.score.tolist()) for g in groups for i, _, _, b in g.items])
    assert results[0] == results[1] == results[2] and len(results[0]) == 30


def test_search_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 2, 3, "x")], "doc_id long, text string, id int, n int, `a.b` string")
    items = spark.createDataFrame([("q", "B c", 1)], "item_id string, text string, rank int")
    assert [tuple(r) for r in T.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [("q", 1, 1)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.withColumn("text", F.lit("?")))):
        out = T.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


# --- license scan -----------------------------------------------------------

def test_rules_are_many_and_gated():
    assert len(RULES) > 300
    for r in RULES:
        assert r.needs and all(w in r.pattern for w in r.needs)
    assert [(r.label, r.pattern.strip().replace("  ", " ")) for r in RULES if r.level == 0] == list(BASE)


def detections(text, scanner=C.Scanner()):
    """Every rule on every text, containment by comparing all pairs."""
    ws = words_of(text)
    stream = " " + "  ".join(ws) + " "
    hits = [(r.level, stream[:m.start()].count(" ") // 2, m.group().count(" ") // 2, i, r)
            for i, r in enumerate(RULES) for m in re.finditer(r.pattern, stream)]
    out = []
    for level, s, n, i, r in hits:
        inside = any(o[0] <= level and o[1] <= s and o[1] + o[2] >= s + n
                     and (o[0] < level or o[2] > n or (o[2] == n and o[3] < i))
                     for o in hits if (o[1], o[2], o[3]) != (s, n, i))
        out.append((s, n, i, r.label, level == 0 or not inside))
    return [x[3:] + x[:2] for x in sorted(out)]


LINES = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "All rights reserved.",
         "GNU General Public License, version 2 or later", "CC-BY-SA 3.0", "the GPLv3 and LGPL 2.1 only",
         "Licensed under the Apache License, Version 2.0.", "Copyright (c) 2020 x", "cc by cc by",
         "Creative Commons Attribution-ShareAlike 4.0", "creative commons attribution share alike",
         "Affero General Public License v3", "zlib libpng license", "public domain dedication"]


def test_scan_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = sorted({w for rule in RULES for w in rule.needs}) + ["zz", "é", "2", "0"]
    texts = [None, "", "?!", "nothing here", *LINES, " ".join(LINES * 40)]
    for _ in range(150):
        parts = [r.choice(LINES) if r.random() < .4 else " ".join(r.choice(vocabulary) for _ in range(4))
                 for _ in range(r.randint(0, 8))]
        texts.append(" ".join(parts))
    rows = [(i % 100, t, "x") for i, t in enumerate(texts)] + [(None, LINES[0], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row.t` string").repartition(4)
    got = C.license_detections(docs, ["doc_id", "row.t"])
    assert got.columns == ["doc_id", "row.t", "n_words", "detections"]
    want = Counter((i, len(words_of(t)), str(detections(t))) for i, t, _ in rows)
    assert Counter((x["doc_id"], x["n_words"], str([(d["label"], d["kept"], d["start"], d["words"])
                                                    for d in x["detections"]])) for x in got.collect()) == want


def test_license_digests(spark):
    rows = [(1, "x " + LINES[0]), (2, "All rights reserved. " + LINES[1] + " all rights reserved"), (3, None)]
    out = C.digests(C.license_detections(spark.createDataFrame(rows, "doc_id long, text string"),
                                         ["doc_id"]), ["doc_id"])
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert got[1] == (8, 1, 3, 3, "cc-by", "cc-by,cc-by-nc-4.0,licensed", 0.95)
    assert got[2][:5] == (11, 2, 0, 8, "reserved") and "mit" in got[2][5].split(",")
    assert got[3] == (0, 0, None, None, "", "", 0.0)
    assert C.license_detections(spark.createDataFrame(rows, "doc_id long, text string").limit(0),
                                ["doc_id"]).count() == 0


# --- token alignment --------------------------------------------------------

def aligned(rows):
    """Documents and pair counts from the two libraries, token by token."""
    a_lib = Tokenizer.from_file(BYTE_BPE)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(
        b for b in range(256) if b not in plain)}
    docs, held = [], Counter()
    for d, text in rows:
        whole = (" " + text).encode() if text else b""
        enc = a_lib.encode(" " + text, add_special_tokens=False) if text else None
        a = [(i, bytes(byte[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)] if text else []
        b = [(i, bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i)
              else b_lib.id_to_piece(i).replace("▁", " ").encode()) for i in b_lib.encode(text)] if text else []
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((d, [], 0, 0, [], ""))
            continue
        links, groups, i, j = [], [], 0, 0
        ends, group = [len(a[0][1]), len(b[0][1])], ([a[0][0]], [b[0][0]])
        while True:
            links.append((a[i][0], b[j][0]))
            x, y = ends
            if x == y:
                groups.append(group)
            if x == y and i + 1 == len(a):
                break
            if x <= y:
                i += 1
                ends[0] += len(a[i][1])
            if y <= x:
                j += 1
                ends[1] += len(b[j][1])
            if x == y:
                group = ([a[i][0]], [b[j][0]])
            else:
                group[0 if x < y else 1].append(a[i][0] if x < y else b[j][0])
        held.update(set(links))
        text_of = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        docs.append((d, links, len(a), len(b), groups, hashlib.sha256(text_of.encode()).hexdigest()))
    best = {}
    for (x, _), c in held.items():
        best[x] = max(best.get(x, 0), c)
    return (sorted(((d, na, nb, len(g), len(ln), sum(held[p] == best[p[0]] for p in ln),
                     sum(held[p] for p in ln), h) for d, ln, na, nb, g, h in docs), key=str),
            sorted((x, y, c) for (x, y), c in held.items()))


ODD = [(None, "a▁b"), (900, None), (901, ""), (902, " "), (904, "<0x41>A <s></s>"),
       (903, "aaaa aaaaaaaaaaa  \n\n x<|endoftext|><s> é日本語🙂\x00\t"), (903, "日本 🙂"), (905, "  two  spaces \n x"),
       (906, "x   y　z  "), (907, "plain words then ▁ here"), (908, "b" * 5000)]


def test_alignment_equals_libraries(spark, monkeypatch):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
            .select("doc_id", "text").collect()] + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = aligned(rows)
    for most in (A.MAX_PAIRS, 300, 0):          # counts by broadcast, by both ways, by joins
        monkeypatch.setattr(A, "MAX_PAIRS", most)
        out, pairs = A.alignment(docs, BYTE_BPE, PIECE_BPE)
        assert sorted(map(tuple, out.collect()), key=str) == want[0]
        assert sorted(map(tuple, pairs.collect())) == want[1]


def test_alignment_in_small_steps(spark, monkeypatch):
    """Tasks that merge and hand on their pair counts many times."""
    rows = [(i, "some words unaligned tokenizations " * (i % 3) + f"nº{i} x{i}y") for i in range(80)] + ODD
    for name, value in (("GATHERED", 50), ("DISTINCT", 30)):
        monkeypatch.setattr(A, name, value)
    out, pairs = A.alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(2),
                             BYTE_BPE, PIECE_BPE)
    want = aligned(rows)
    assert sorted(map(tuple, out.collect()), key=str) == want[0]
    assert sorted(map(tuple, pairs.collect())) == want[1]


def test_aligner_forgets_words_without_changing_results(monkeypatch):
    files = [open(f, "rb").read() for f in (BYTE_BPE, PIECE_BPE)]
    texts = [f"nº{i % 17} some unaligned x{i % 5}y tokenizations" for i in range(60)] + [t for _, t in ODD]
    whole = A.Aligner(*files).align(texts)
    for name, value in (("REMEMBERED_WORDS", 20), ("JOINED", 3)):
        monkeypatch.setattr(A, name, value)
    small = A.Aligner(*files)
    parts = [small.align(texts[i:i + 4]) for i in range(0, len(texts), 4)]
    for column, values in whole.items():
        got = [x for p in parts for x in (p[column] if isinstance(p[column], list) else p[column].to_pylist())]
        assert got == (values if isinstance(values, list) else values.to_pylist()), column


def test_alignment_of_other_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("k", "a word", 1, "z")], "id string, text string, row int, `a.b` string")
    out, _ = A.alignment(docs, BYTE_BPE, PIECE_BPE, "id")
    assert [(r["id"], r["n_a"]) for r in out.collect()] == [("k", 2)]
    out, pairs = A.alignment(docs.limit(0), BYTE_BPE, PIECE_BPE, "id")
    assert out.count() == pairs.count() == 0


def test_word_pattern_and_word_cuts():
    a = A.ByteBpe(open(BYTE_BPE, "rb").read())
    lib = Tokenizer.from_file(BYTE_BPE)
    lib.encode_special_tokens = True
    r = random.Random(6)
    chars = list("ab1é日 .\n\t' 　\x1c🙂") + ["  ", "<|endoftext|>", "'s"]
    aligner = A.Aligner(open(BYTE_BPE, "rb").read(), open(PIECE_BPE, "rb").read())
    for _ in range(300):
        t = "".join(r.choice(chars) for _ in range(r.randint(1, 25)))
        assert a.encode(" " + t) == lib.encode(" " + t, add_special_tokens=False).ids
        cut = aligner._words(t)
        assert " ".join(cut) == t
        assert [i for w in cut for i in a.encode(" " + w)] == a.encode(" " + t)
