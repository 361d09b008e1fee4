"""Row-wise operators against libraries and brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import SF_SMALL
from talentscope.llm import decontaminate as D
from talentscope.llm import html_extract as H
from talentscope.llm import language_id as L
from talentscope.llm import quality_gam as G
from talentscope.llm import quality_rules as Q
from talentscope.llm import queries as _queries  # noqa: F401
from talentscope.llm import sentencepiece_bpe as S
from talentscope.llm import url_filter as U
from talentscope.llm.registry import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- SentencePiece ----------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _random_texts():
    r = random.Random(4)
    out = [None, "", " ", "   ", "a" * 2000, "the" * 300, " " * 400, "\n\n x", "<s></s><0x41>", "▁▁a",
           "日本語" * 20, "éè" * 9, "\x00\x01", "😀 é"]
    for alphabet in ("aabtheinTHE  \n\t\x00é漢😀▁ß<>0x41s", "then in", "  ▁a", "lo lol"):
        out += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(600)]
    return out


def test_bpe_equals_library(library):
    bpe = S.Bpe(S.load_vocabulary(MODEL))
    texts = _random_texts()
    flat, offsets = bpe.encode(texts)
    want = library.encode([t or "" for t in texts])
    got = [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == want
    assert bpe.decode(flat, offsets) == [library.decode(w) for w in want]


def test_bpe_forgets_words_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED_WORDS", 5)
    bpe = S.Bpe(S.load_vocabulary(MODEL))
    for t in _random_texts()[:200]:
        assert bpe.encode([t])[0].tolist() == library.encode(t or "")


def test_encode_decode_columns(spark, library):
    df = docs_of(spark, [(1, "Hello  world"), (2, None), (None, ""), (1, "Hello  world")]).withColumn(
        "ids", F.lit("clash"))
    enc = S.encode(df, MODEL)
    assert enc.columns == ["doc_id", "text", "ids"]
    back = S.decode(enc, MODEL).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == ["", "Hello  world", "Hello  world", ""]
    assert back[1]["ids"] == library.encode("Hello  world")
    assert S.encode(df.limit(0), MODEL).count() == 0


def test_op5_digests(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op5_sentencepiece"](spark, SF_SMALL).collect():
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# --- decontamination --------------------------------------------------------

def _hits(items, text, window):
    ws = D.words_of(text)
    hit, met = [0] * len(ws), set()
    for item, t in items:
        iw = D.words_of(t)
        m = min(window, len(iw))
        wins = {tuple(iw[k:k + m]) for k in range(len(iw) - m + 1)} if iw else set()
        for k in range(len(ws) - m + 1 if iw else 0):
            if tuple(ws[k:k + m]) in wins:
                met.add(item)
                hit[k:k + m] = [1] * m
    return len(ws), sum(hit), met


def test_automaton_against_brute_force():
    r = random.Random(2)
    for _ in range(200):
        v = ["a", "b", "C", "d1"][:r.randint(1, 4)]
        window = r.choice([1, 2, 3, 10])
        items = [(str(i), " ".join(r.choice(v) for _ in range(r.randint(0, 8 if window < 10 else 25))))
                 for i in range(r.randint(1, 6))]
        auto = D.Automaton([(i, D.words_of(t)) for i, t in items], window)
        texts = [" ".join(r.choice([*v, "zz"]) for _ in range(r.randint(0, 40))) + r.choice(
            ["", " " + items[0][1]]) for _ in range(5)] + [None, "", "?!"]
        for t, (n, spans, met) in zip(texts, D.scan(auto, texts)):
            assert (n, sum(e - s for s, e in spans), met) == _hits(items, t, window)


def test_word_rule():
    assert D.words_of("It's A-B_c ÉÀ\x7f9") == [b"it", b"s", b"a", b"b", b"c", "ÉÀ".encode(), b"9"]
    assert D.cut_words("One, two! (three) four", [(1, 3)]) == "One, ) four"


def test_blocks_and_pieces_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")

    def digest():
        return sorted(map(tuple, D.digests(D.contamination(docs, bench, ["doc_id"]), ["doc_id"])
                          .collect()))
    whole = digest()
    monkeypatch.setattr(D, "BLOCK_BYTES", 1500)
    assert digest() == whole


def test_contamination_is_removed(spark):
    item = " ".join(f"w{i}" for i in range(12))
    clean = " ".join(f"c{i}" for i in range(40))
    rows = [(1, f"{clean}. {item}, tail"), (2, item), (3, clean), (4, None), (None, ""), (3, clean)]
    docs = docs_of(spark, rows).withColumn("n_chars", F.length("text")).withColumn("spans", F.lit(1))
    bench = spark.createDataFrame([(9, item), (10, None), (11, "?"), (None, "zz yy")],
                                  "item_id long, text string")
    out = D.remove_contamination(docs, bench)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {(1, f"{clean}. , tail", len(clean) + 8), (3, clean, len(clean)), (4, None, None),
                   (None, "", 0)}
    assert out.count() == 5
    assert D.remove_contamination(docs, bench.limit(0)).count() == 6
    assert D.remove_contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [120, 400])
def test_removal_does_not_depend_on_blocks(spark, monkeypatch, block):
    """Items of several blocks share a stem whose cut must not hide their short tails."""
    stem = [f"s{i}" for i in range(14)]
    tails = [[f"q{i}x{k}" for k in range(6)] for i in range(12)]
    items = [(i, " ".join(stem + t)) for i, t in enumerate(tails)]
    long = [f"l{i}" for i in range(60)]              # cut into pieces, some with short ends
    clean = [f"c{i}" for i in range(90)]
    rows = [(i, " ".join(clean + stem + t + clean)) for i, t in enumerate(tails)]
    rows += [(50, " ".join(clean + long + clean)), (51, " ".join(clean)), (52, None),
             (53, " ".join(stem + tails[0] + clean[:30])), (54, " ".join(stem + tails[1])),
             # a cut that joins a window anew
             (55, " ".join(clean + stem[:7] + long[:20] + stem[7:] + tails[2] + clean)), (50, "c1")]
    r = random.Random(8)
    pool = stem + tails[0] + long[:12]
    rows += [(100 + i, " ".join(clean + [r.choice(pool) for _ in range(8)] + r.choice(items)[1].split()
                                [r.randint(0, 5):] + clean[:r.randint(0, 9)])) for i in range(25)]
    docs = docs_of(spark, rows).withColumn("n_chars", F.length("text"))
    bench = spark.createDataFrame([*items, (90, " ".join(long))], "item_id long, text string")

    def result():
        return sorted(map(tuple, D.remove_contamination(docs, bench).collect()), key=str)
    whole = result()
    assert (0, " ".join(clean) + "  " + " ".join(clean)) in {x[:2] for x in whole}
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    assert result() == whole


# --- quality rules ----------------------------------------------------------

def _base(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    hit = [0] * len(ws)
    for i in range(len(ws) - 7):
        if c[tuple(ws[i:i + 8])] > 1:
            hit[i:i + 8] = [1] * 8
    return (len(ws), sum(map(len, ws)), sum(x in "#*$%&|<>" for x in text),
            len(lines) - len(set(lines)), sum(hit))


def test_base_counts_and_cases(spark):
    r = random.Random(1)
    texts = [None, "", " \n", "a", "x\n\nx\n x", "é#$ <b> ü\x0b\x0cz"]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += ["\n".join(["one two three four five six seven eight nine"] * 3), "w " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (0, None)]
    df = docs_of(spark, rows).withColumn("lang", F.lit(None).cast("string")).withColumn(
        "n_words", F.lit("clash"))
    for x in Q.quality_verdicts(df).collect():
        n, chars, sym, dup, rep = _base(x["row"]["text"])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"],
                x["n_repeat_words"]) == (n, chars, sym, dup, rep)
        assert x["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert x["kept"] == (not x["base_failed"])       # no language, no reference
    assert Q.filter_quality(df).columns == df.columns
    assert Q.filter_quality(df.limit(0)).count() == 0


def test_quality_rules_separate_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter(
        "not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.15


def test_quality_rules_of_any_language(spark):
    """Languages without fixed words get a reference of their own, which still tells junk."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    letters = "abcdefghijklmnopqrstuvwxyz"
    other = F.translate("text", letters + letters.upper(), letters[7:] + letters[:7]
                        + (letters[7:] + letters[:7]).upper())
    renamed = docs.select("doc_id", F.when(F.col("lang") == "en", other).otherwise(F.col("text")).alias(
        "text"), F.when(F.col("lang") == "en", "xx").otherwise(F.col("lang")).alias("lang"))
    got = Q.quality_verdicts(renamed).select("row.*", "base_failed", "kept").join(labels, "doc_id").filter(
        "not base_failed and lang = 'xx'").toPandas()
    assert len(got) > 100
    assert got[got.quality == 1].kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.15
    # no reference: no language, a language of short texts only, a fixed one of short texts only
    odd = " ".join(f"ж{i}ы" for i in range(40))
    rows = [(-1, odd + " " + odd[::-1], None), (-2, odd, "kk"), (-3, odd, "zz"), (-4, "ж " * 9, "kk")]
    cases = renamed.filter("lang = 'de'").union(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"]: (r["kept"], r["divergence"]) for r in Q.quality_verdicts(cases).select(
        "row.doc_id", "kept", "divergence").filter("doc_id < 0").collect()}
    assert kept == {-1: (True, None), -2: (True, None), -3: (True, None), -4: (False, None)}


# --- url filter -------------------------------------------------------------

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"))


def test_urls_and_rules(spark):
    cases = {
        1: ("http://WWW.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        2: ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        3: ("x://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        4: ("http://a.net", "a.net", "", None, "allow"),
        5: ("http://net/es/?", "net", "/es/", "net/es/", "block"),
        6: (None, "", "", None, "allow"), 7: ("no scheme", "", "", None, "allow"),
        8: ("://É.org?q=/a", "É.org", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    for r in U.url_verdicts(pages, none, RULES).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["page_id"]][1:]
    assert U.url_verdicts(pages.limit(0), none, RULES).count() == 0
    with pytest.raises(ValueError):
        U.rule_columns(F.col("host"), F.col("path"), [("block", f"h{i}", "/") for i in range(501)])


def test_reputation_shrinks_and_blocks(spark):
    hosts = [("bad.x.org", 60, 55), ("few.x.org", 1, 1), *[(f"g{i}.x.org", 50, 2) for i in range(8)],
             ("new.x.org", 0, 0), ("other.net", 0, 0)]
    rep = {r["host"]: r for r in U.host_reputation(
        spark.createDataFrame(hosts, "host string, n long, k long")).collect()}
    assert rep["bad.x.org"]["bad_low"] > U.MAX_BAD
    assert rep["few.x.org"]["bad_low"] < U.MAX_BAD        # one bad page does not convict a host
    assert rep["g0.x.org"]["bad_mean"] < 0.1
    assert 0 < rep["new.x.org"]["bad_mean"] < 0.4
    assert rep["new.x.org"]["bad_low"] <= rep["new.x.org"]["bad_mean"] <= rep["new.x.org"]["bad_high"]


# --- classifiers ------------------------------------------------------------

def test_quality_gam_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_quality_gam"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"),
                                                     "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_gam_cases(spark):
    docs = docs_of(spark, [(1, "a b c"), (None, None), (2, ""), (1, "a b c")])
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    model = G.train(docs, none)
    assert {r["score"] for r in G.score_documents(docs, model, ["doc_id"]).collect()} == {0.5}
    one = G.fit(np.zeros((4, len(G.FEATURES))), np.ones(4))
    assert 0.7 < G.score(one, np.zeros((1, len(G.FEATURES))))[0] < 1
    assert G.score_documents(docs.limit(0), model, ["doc_id"]).count() == 0


def test_gam_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = G.score(G.fit(x[:3000], y[:3000]), x[3000:])
    assert ((p > 0.5) == (y[3000:] > 0.5)).mean() > 0.9


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_language_id"](spark, sf).toPandas().merge(
        pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_cases(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate(
        [("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    docs = spark.createDataFrame(rows + [(90, None, "en"), (91, "", None), (92, "12 -- 3", "fr"),
                                         (None, "the end", "en"), (93, "le chat", None)],
                                 "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"])
           for r in L.predict(docs, L.train(docs), ["doc_id"]).collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0)
    assert got[93][0] == "fr" and got[None][0] == "en"
    assert L.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in L.predict(docs, None, ["doc_id"]).collect()} == {"und"}


# --- html -------------------------------------------------------------------

def test_html_cases():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p> </p>") == ""
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
      <nav><ul><li><a href='/a'>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
      <article><header><h1>A &amp; B</h1></header><p>First\n  line <b>bold</b>&nbsp;end<br>next
      <p>Second &lt;3 <script>var x = "</p>";</script>tail</p><aside>Aside</aside>
      <form><input><p>Form</p></form><div class="ad">Buy</div><ul><li>one<li>two</ul>
      <section id="comments"><p>Nice!</p></section></article>
      <div id="sidebar"><p>Side</p></div><!-- <p>no</p> --><footer>F</footer></body></html>"""
    assert H.main_text(page) == "A & B\nFirst line bold end next\nSecond <3 tail\none\ntwo"


def test_html_two_passes_without_article():
    long = "It is the story of a man and of the sea, and that was all for the day. " * 4
    page = (f"<div><a href=x>Home</a> <a href=y>News</a></div><h2>Title</h2><p>{long}</p><p>Yes.</p>"
            f"<p>{long}</p><ul><li><a href=z>Terms</a></li></ul><p>Imprint</p><p><a href=q>x</a></p>")
    assert H.main_text(page).split("\n") == ["Title", long.strip(), "Yes.", long.strip()]
    assert H.main_text("just a few words") == "just a few words"


def test_html_article_inside_an_out_scope():
    page = "<body><div class=top>Top</div>{}<footer>F</footer></body>"
    inner = "<h1>Head</h1><p>First words of it.</p><aside>A</aside><p>Last words.</p>"
    want = "Head\nFirst words of it.\nLast words."
    for wrapped in (f'<form id=aspnetForm><main>{inner}</main><p>Field</p></form>',
                    f'<form><div class="sidebar-wrap"><article>{inner}</article></div></form>',
                    f"<div class='content-sidebar-wrap'><main>{inner}</main><p class=widget>W</p></div>",
                    f"<div class='content has-sidebar'>{inner}</div>",
                    f"<article class='post no-comments'>{inner}</article>",
                    f"<article class='post sidebar'>{inner}</article>",
                    f"<div class='overlay'><article>{inner}</article></div>"):
        assert H.main_text(page.format(wrapped)) == want, wrapped
    # still out: the parts of an article, comments and teasers beside it, forms without an article
    rest = ("<div id=comments><article class=comment><p>Nice!</p></article></div>"
            "<div class='related-posts'><article><p>Other page</p></article></div>"
            "<form><p>Field</p></form><nav><article>N</article></nav>")
    parts = "<div class='post-share'>Share</div><div class='related-content'>More</div>"
    assert H.main_text(page.format(f"<article>{inner}{parts}</article>{rest}")) == want


def test_html_of_table(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").toPandas().set_index("page_id").html
    for r in QUERIES["op9_html_extract"](spark, SF_SMALL).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        import html
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split())
                 for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in parts if x)
        assert r["n_chars"] == len(r["text"])


def test_long_words_equal_the_library(library):
    """Words far beyond LONG_WORD: many ranks, runs of one pair, characters without pieces."""
    bpe = S.Bpe(S.load_vocabulary(MODEL))
    r = random.Random(3)
    for alphabet in ("a", "aab", "the", "abcdefghijklmnopqrstuvwxyz", "= -", "日本é🙂a", "ABCghij0123456789+/", "\n\ta"):
        texts = ["".join(r.choice(alphabet) for _ in range(r.choice([255, 256, 257, 300, 5000]))) for _ in range(12)]
        flat, offsets = bpe.encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == library.encode(texts)


def test_long_words_take_linear_time(library):
    import time
    bpe = S.Bpe(S.load_vocabulary(MODEL))
    r = random.Random(5)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "a"):
        word = "".join(r.choice(alphabet) for _ in range(1_000_000))
        t = time.time()
        ids = bpe.encode([word])[0].tolist()
        own, t = time.time() - t, time.time()
        assert ids == library.encode(word)
        assert own < 20 * max(0.3, time.time() - t)


def test_html_comments_links_and_depth():
    import time
    text = "The article is about the things that are in the town and of the people who were there for it. " * 4
    comment = "<article>I like the text of it and that is all for now.</article>"
    for name in ('id="comments"', 'class="post-comments"', 'id="disqus"'):
        page = f"<div {name}>{comment}</div><div><p>{text}</p></div>"
        assert H.main_text(page) == text.strip()
        assert H.main_text(f"<article><p>{text}</p></article><div {name}>{comment}</div>") == text.strip()
    assert H.main_text(f"<div class=comments>{comment}</div>").startswith("I like")     # nothing else
    link = "<li><a href=x>{}</a></li>"
    article = f"<article><p>{text}</p><ul><li>first</li>{link.format('second')}</ul>{{}}</article><footer>F</footer>"
    assert H.main_text(article.format("")).endswith("first\nsecond")
    inner = "".join(link.format(i) for i in range(5))
    assert H.main_text(article.format(f"<ul>{inner}</ul><p>Last words.</p>")).endswith("0\n1\n2\n3\n4\nLast words.")
    assert H.main_text(article.replace("<li>first</li>", "<li>a</li><li>b</li>").format(f"<p>x</p><ul>{inner}</ul>")).endswith("x")
    for page in ("<div>x" * 100_000, "<div>" * 100_000 + "</span>x" * 100_000, "<h1><b>" * 50_000 + "<p>x" * 50_000):
        t = time.time()
        H.main_text(page)
        assert time.time() - t < 5


def _plain_blocks(page):
    """Blocks as the rules say them, with a stack searched anew at every step."""
    out, stack, text = [], [], []

    def close():
        t = " ".join("".join(text).split())
        if t:
            out.append((t, any(re.match("h[1-6]$", x) for x in stack)))
        text.clear()
    for m in re.finditer(r"<(/?)([a-z0-9]+)>|([^<]+)", page):
        end, tag, words = m.groups()
        if words:
            text.append(words)
        elif tag == "br":
            text.append(" ")
        elif end:
            if tag in H.BLOCK_TAGS:
                close()
            if tag in stack:
                del stack[len(stack) - 1 - stack[::-1].index(tag):]
        else:
            if tag in H.BLOCK_TAGS:
                close()
                if tag in ("p", "li", "dd", "dt") or re.match("h[1-6]$", tag):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i] == tag:
                            del stack[i:]
                            break
                        if stack[i] in H.BLOCK_TAGS and stack[i] != "p":
                            break
            stack.append(tag)
    close()
    return out


def test_html_blocks_equal_a_plain_reading():
    r = random.Random(12)
    tags = ["p", "div", "li", "ul", "h1", "h2", "b", "i", "dd", "dt", "br", "table", "td"]
    for _ in range(1500):
        page = "".join(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags[:10])}>", r.choice(["w ", " x", "y\n", " "])])
                       for _ in range(r.randint(0, 40)))
        assert [(b[0], b[3]) for b in H.blocks(page)] == _plain_blocks(page), page


def test_many_languages_are_all_learned(spark):
    """More languages than fit the sample at an equal share: none is left out."""
    r = random.Random(2)
    rows = []
    for lang in range(60):
        letters = "".join(chr(0x4E00 + lang * 3 + k) for k in range(3))
        rows += [(lang * 40 + i, " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(20)), f"l{lang}")
                 for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs, max_rows=60)
    assert len(model["names"]) == 60
    got = {x["doc_id"]: x["lang_pred"] for x in L.predict(docs, model, ["doc_id"]).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.9 * len(rows)


def test_stages_keep_columns_of_any_name(spark):
    from talentscope.llm import ngram_join as N
    from talentscope.llm import suffix_dedup as X
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, body, 1, "a", "b", "c", "d", "e", 5), (2, body + " more", 1, "a", "b", "c", "d", "e", 6),
            (3, None, 1, "a", "b", "c", "d", "e", 7)]
    names = ["doc_id", "text", "a.b", "__text", "__gone", "row", "t", "id", "x`y"]
    docs = spark.createDataFrame(rows, ["c%d" % i for i in range(9)]).toDF(*names)
    bench = spark.createDataFrame([(1, "q " * 12)], "item_id long, text string")
    for out in (Q.filter_quality(docs.withColumn("lang", F.lit("en"))).drop("lang"), N.keep_one_per_group(docs),
                X.dedup(docs), D.remove_contamination(docs, bench), S.encode(docs, MODEL).drop("ids")):
        assert out.columns == names
        assert {tuple(r)[2:8] for r in out.collect()} <= {(1, "a", "b", "c", "d", "e")}
    assert {r["doc_id"] for r in N.keep_one_per_group(docs).collect()} == {1, 3}


# --- training steps against plain loops ------------------------------------

def test_tree_and_pair_steps_equal_all_cuts():
    r = np.random.default_rng(1)

    def value(g, h):
        return g.sum() / (h.sum() + G.SHRINK)

    def gain(*parts):
        return sum(g.sum() ** 2 / (h.sum() + G.SHRINK) for g, h in parts)
    for _ in range(60):
        n = int(r.integers(2, 12))
        g, h = r.normal(size=n), r.uniform(.1, 2, n)

        def split(lo, hi):
            cuts = [gain((g[lo:k], h[lo:k]), (g[k:hi], h[k:hi])) for k in range(lo + 1, hi)]
            if not cuts or max(cuts) <= gain((g[lo:hi], h[lo:hi])) + 1e-9:
                return [(lo, hi)]
            k = lo + 1 + int(np.argmax(cuts))
            return [(lo, k), (k, hi)]
        want = np.zeros(n)
        for part in split(0, n):
            for lo, hi in split(*part):
                want[lo:hi] = value(g[lo:hi], h[lo:hi])
        assert np.allclose(G._tree(g, h), want)
        grid, weight = r.normal(size=(5, 5)), r.uniform(.1, 2, (5, 5))
        best = None
        for i in range(1, 5):
            for j in range(1, 5):
                parts = [(grid[a, b], weight[a, b]) for a in (slice(0, i), slice(i, 5)) for b in (slice(0, j), slice(j, 5))]
                if best is None or gain(*parts) > best[0] + 1e-12:
                    cells = np.zeros((5, 5))
                    for a in (slice(0, i), slice(i, 5)):
                        for b in (slice(0, j), slice(j, 5)):
                            cells[a, b] = value(grid[a, b], weight[a, b])
                    best = (gain(*parts), cells)
        got = G._quadrants(grid, weight)
        assert np.isclose(got[0], best[0] - gain((grid, weight))) and np.allclose(got[1], best[1])


def test_gam_scores_are_table_sums():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, len(G.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > .3)).astype(float)
    m = G.fit(x, y)
    got = G.score(m, x[:50])
    for row, p in zip(x[:50], got):
        total = m["base"]
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, m["edges"])]
        total += sum(t[b] for t, b in zip(m["tables"], bins))
        total += sum(t[cf[bins[f]], cg[bins[g]]] for f, g, cf, cg, t in m["pairs"])
        assert np.isclose(p, 1 / (1 + np.exp(-total)))
    assert ((got > .5) == (y[:50] > .5)).mean() > .9


def test_ftrl_equals_a_plain_loop():
    import math
    r = random.Random(7)
    rows = []
    for _ in range(40):
        at = sorted(r.sample(range(25), r.randint(1, 6)))
        rows.append((np.array(at), np.array([r.random() for _ in at]), r.randrange(3)))
    z, n = Counter(), Counter()

    def weight(i, k):
        if abs(z[i, k]) <= L.L1:
            return 0.0
        return -(z[i, k] - math.copysign(L.L1, z[i, k])) / ((L.BETA + math.sqrt(n[i, k])) / L.ALPHA + L.L2)
    for _ in range(L.EPOCHS):
        for at, v, truth in rows:
            feats = [*zip(at.tolist(), v.tolist()), (L.BUCKETS, 0.1)]
            w = {(i, k): weight(i, k) for i, _ in feats for k in range(3)}
            logit = [sum(x * w[i, k] for i, x in feats) for k in range(3)]
            e = [math.exp(x - max(logit)) for x in logit]
            for i, x in feats:
                for k in range(3):
                    g = x * (e[k] / sum(e) - (k == truth))
                    z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / L.ALPHA * w[i, k]
                    n[i, k] += g * g
    got = L.ftrl(rows, 3)
    want = np.array([[weight(i, k) for k in range(3)] for i in [*range(25), L.BUCKETS]])
    assert np.allclose(got[[*range(25), L.BUCKETS]], want)
    assert not got[25:L.BUCKETS].any()
