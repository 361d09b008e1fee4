"""Quality rules: repetition and length floor, then distribution divergence.

Built-in SQL functions only. A document's character-class histogram and its
histogram of common words are compared with references of each language by the
Jensen-Shannon distance (base 2). The references are the medians, bin by bin, over
all documents of that language, so neither long documents nor junk shift them. Every
language that the documents name has one: the common words of the languages in
``COMMON_WORDS`` are fixed, those of any other are the words that most of its
documents hold. A document is kept if, for at least one language among the fixed ones
and its own, both distances stay below their limits.
Guards: the character test needs ``MIN_CHARS`` characters, the word test
``MIN_WORDS`` words; shorter documents pass that test.

Defined cases: a NULL text has no words; documents without words fail the base
rule; a NULL language joins no reference; documents whose language has no reference
(a NULL one, or one without any document of ``MIN_WORDS`` words) are judged by the
base rule alone; repeated rows are judged alike; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentscope.llm.common import WORD_SPACE, staged

BASE_MIN_WORDS = 20
BASE_MAX_REPEAT = 30          # per cent of the words
WINDOW = 8
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.17       # plus SHORT_SLACK / characters: short texts vary more
SHORT_SLACK = 20.0
MAX_WORD_DISTANCE = 0.28
SMOOTH = 1e-4
ACCURACY = 1000               # of the median sketches, which have a fixed size
OWN_WORDS = 10                # common words of a language that is not listed below
MAX_BROADCAST_LANGUAGES = 10_000   # of some 500 bytes; more are joined by a shuffle

# Common words per language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "des", "ein"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las"),
}
BINS = tuple(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))
# Character classes, as Java regex class bodies; the rest is one more class.
CHAR_CLASSES = (r"\p{Ll}", r"\p{Lu}", r"0-9", WORD_SPACE, r".,;:?'\"()\-", r"!", r"#*$%&|<>")


def _let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row (a lambda that names an
    outer expression would evaluate it once per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WORD_SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more."""
    def hashes(ws):
        return F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.xxhash64(
            *[F.get(ws, i + k) for k in range(WINDOW)]))

    def covered(h):
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s):
            last = F.size(s) - 1
            near = F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (
                (j > 0) & (F.get(s, j - 1)["h"] == x["h"])
                | (j < last) & (F.get(s, j + 1)["h"] == x["h"])).alias("d")))
            return F.array_sort(F.transform(F.filter(near, lambda y: y["d"]), lambda y: y["i"]))

        def step(acc, x):
            return F.struct((acc["c"] + F.least(F.lit(WINDOW), x - acc["p"])).alias("c"),
                            x.alias("p"))
        return F.aggregate(_let(ranked, starts),
                           F.struct(F.lit(0).alias("c"), F.lit(-WINDOW).alias("p")),
                           step, lambda acc: acc["c"])

    def count(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(
        _let(_let(_let(words, lambda ws: F.transform(ws, lambda w: F.xxhash64(w))), hashes),
             count)).cast("long")


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WORD_SPACE}]"))
    dup = _let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, f"[{WORD_SPACE}]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def char_counts(text: Column) -> Column:
    """Characters per class of ``CHAR_CLASSES``, then all others. Rare classes are
    counted by cutting the long runs of everything else; the commonest, the
    first, is what remains."""
    rare = [F.length(F.regexp_replace(text, f"[^{c}]+", "")) for c in CHAR_CLASSES[1:]]
    other = F.length(F.regexp_replace(text, f"[{''.join(CHAR_CLASSES)}]+", ""))
    rest = [x.cast("double") for x in [*rare, other]]

    def with_first(xs):
        return F.concat(F.array(F.length(text) - F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)),
                        xs)
    return _let(F.array(*rest), with_first)


def word_counts(words: Column) -> Column:
    """Occurrences of each common word, then all other words. The common words
    are joined with double spaces, so that each keeps its own two."""
    common = F.filter(words, lambda w: w.isin(*BINS))
    joined = F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" "))

    def counts(j):
        each = [(F.length(j) - F.length(F.replace(j, F.lit(f" {b} "), F.lit(""))))
                / F.lit(len(b) + 2) for b in BINS]
        return F.array(*each)

    def with_rest(c):
        return F.concat(c, F.array(F.size(words) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x)))
    return _let(_let(joined, counts), with_rest)


def own_counts(words: Column, own: Column) -> Column:
    """Occurrences of each word of the array column ``own``, then all other words."""
    def joined(ws):
        return F.concat(F.lit(" "), F.array_join(
            F.filter(ws, lambda w: F.array_contains(own, w)), "  "), F.lit(" "))

    def counts(j):
        return F.transform(own, lambda b: (F.length(j) - F.length(F.replace(
            j, F.concat(F.lit(" "), b, F.lit(" ")), F.lit("")))) / (F.length(b) + 2))

    def with_rest(ws):
        return _let(_let(joined(ws), counts), lambda c: F.concat(
            c, F.array(F.size(ws) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x))))
    return _let(words, with_rest)


def _shares(counts: Column) -> Column:
    """Counts as shares of their sum (all 0 where the sum is 0)."""
    def scaled(c):
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        return _let(total, lambda t: F.transform(
            c, lambda x: F.when(t > 0, x / t).otherwise(0.0)))
    return _let(counts, scaled)


def js_distance(p: Column, q: list[float] | Column) -> Column:
    """Jensen-Shannon distance (base 2) of a share array to a reference."""
    ref = q if isinstance(q, Column) else F.array(*[F.lit(float(x)) for x in q])

    def term(x, y):
        m = (x + y) / 2
        return (F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
                + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)) / 2
    total = F.aggregate(F.zip_with(p, ref, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), total))


def quality_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: ``row`` (all its columns as a struct), the base counts
    of ``base_columns``, n_chars, and the share histograms ``c`` and ``s``."""
    t, w = F.col("t"), F.col("w")
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select("row", "t", words_of(t).alias("w"))
    return d.select("row", *[c.alias(k) for k, c in base_columns(t, w).items()],
                    F.length("t").alias("n_chars"),
                    _shares(char_counts(t)).alias("c"), _shares(word_counts(w)).alias("s"))


def language_references(features: DataFrame, lang: str = "lang") -> dict:
    """{language: (character shares, word shares)}: median shares over every
    document of a language in ``COMMON_WORDS`` with at least ``MIN_WORDS`` words. At most one
    row per listed language reaches the driver."""
    h = features.filter(F.col("row")[lang].isin(*COMMON_WORDS) & (F.col("n_words") >= MIN_WORDS))
    nc, nw = len(CHAR_CLASSES) + 1, len(BINS) + 1
    rows = h.groupBy(F.col("row")[lang].alias("l")).agg(
        *[F.percentile_approx(F.get("c", F.lit(i)), 0.5, ACCURACY).alias(f"c{i}")
          for i in range(nc)],
        *[F.percentile_approx(F.get("s", F.lit(i)), 0.5, ACCURACY).alias(f"s{i}")
          for i in range(nw)]).collect()

    def smooth(xs):
        total = sum(xs) + SMOOTH * len(xs)
        return [(x + SMOOTH) / total for x in xs]
    return {r["l"]: (smooth([r[f"c{i}"] for i in range(nc)]),
                     smooth([r[f"s{i}"] for i in range(nw)]))
            for r in sorted(rows, key=lambda r: r["l"])}


def own_references(others: DataFrame) -> DataFrame:
    """Staged rows (l, own, c_ref, w_ref) per language ``l`` of documents (l, t, n_words, c)
    with at least ``MIN_WORDS`` words: the words that most of them hold (of equally
    many the more frequent) and the median shares, as in ``language_references``."""
    def counted(ws):
        each = F.transform(ws, lambda w: F.struct(w.alias("w"), F.lit(0).alias("d"),
                                                  F.lit(1).alias("n")))
        once = F.transform(F.array_distinct(ws), lambda w: F.struct(
            w.alias("w"), F.lit(1).alias("d"), F.lit(0).alias("n")))
        return F.concat(each, once)
    long = others.filter(F.col("n_words") >= MIN_WORDS)
    counts = (long.select("l", F.explode(_let(words_of(F.col("t")), counted)).alias("x"))
              .groupBy("l", F.col("x.w").alias("w"))
              .agg(F.sum("x.d").alias("d"), F.sum("x.n").alias("n")))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("d"), F.desc("n"), "w"))
    own = staged(counts.withColumn("place", place).filter(F.col("place") <= OWN_WORDS)
                 .groupBy("l").agg(F.sort_array(F.collect_list("w")).alias("own")), "own_words")
    h = long.join(_bounded(own), "l").select("l", "own", "c", _shares(
        own_counts(words_of(F.col("t")), F.col("own"))).alias("s"))

    def medians(name, n):
        return F.array(*[F.percentile_approx(F.get(name, F.lit(i)), 0.5, ACCURACY)
                         for i in range(n)])

    def smooth(xs):
        return _shares(F.transform(F.filter(xs, lambda x: x.isNotNull()), lambda x: x + SMOOTH))
    rows = h.groupBy("l", "own").agg(medians("c", len(CHAR_CLASSES) + 1).alias("cm"),
                                     medians("s", OWN_WORDS + 1).alias("sm"))
    return staged(rows.select("l", "own", smooth(F.col("cm")).alias("c_ref"),
                              smooth(F.col("sm")).alias("w_ref")), "own_references")


def _bounded(per_language: DataFrame) -> DataFrame:
    """Broadcast where there are few languages: one may hold most of the documents."""
    few = per_language.count() <= MAX_BROADCAST_LANGUAGES
    return F.broadcast(per_language) if few else per_language


def _over(c_ref, shares: Column, w_ref) -> Column:
    """The larger of both distances over its limit."""
    dc = F.when(F.col("n_chars") < MIN_CHARS, 0.0).otherwise(
        js_distance(F.col("c"), c_ref) / (MAX_CHAR_DISTANCE + SHORT_SLACK / F.col("n_chars")))
    dw = F.when(F.col("n_words") < MIN_WORDS, 0.0).otherwise(
        js_distance(shares, w_ref) / MAX_WORD_DISTANCE)
    return F.greatest(dc, dw)


def judge(features: DataFrame, references: dict, text: str = "text",
          lang: str = "lang") -> DataFrame:
    """``row`` and the base counts with base_failed, divergence (the larger of both
    distances over its limit, least among the languages; NULL where the document's
    language has no reference) and kept."""
    language = F.col("row")[lang]
    fixed = [_over(c_ref, F.col("s"), w_ref) for c_ref, w_ref in references.values()]
    failed = ((F.col("n_words") < BASE_MIN_WORDS)
              | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT * F.col("n_words")))

    def verdicts(df, known, over):
        least = (F.lit(None).cast("double") if not over
                 else over[0] if len(over) == 1 else F.least(*over))
        return df.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", failed.alias("base_failed"),
                         F.when(known, least).alias("divergence"))

    listed = F.coalesce(language.isin(*COMMON_WORDS), F.lit(True))
    others = features.filter(~listed)
    known = language.isin(*references) if references else F.lit(False)
    if others.isEmpty():
        out = verdicts(features, known, fixed)
    else:
        others = others.withColumn("l", language).withColumn(
            "t", F.coalesce(F.col("row")[text], F.lit("")))
        found = others.join(_bounded(own_references(others)), "l", "left").withColumn(
            "own_s", _shares(own_counts(words_of(F.col("t")), F.col("own"))))
        own = _over(F.col("c_ref"), F.col("own_s"), F.col("w_ref"))
        out = verdicts(features.filter(listed), known, fixed).union(
            verdicts(found, F.col("own").isNotNull(), [*fixed, own]))
    fits = F.col("divergence").isNull() | (F.col("divergence") <= 1.0)
    return out.withColumn("kept", ~F.col("base_failed") & fits)


def quality_verdicts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Verdict per document (see ``judge``). The features are computed once and
    staged in the shared folder: references and verdicts both read them."""
    features = staged(quality_features(docs, text), "quality")
    return judge(features, language_references(features), text)


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return quality_verdicts(docs).filter("kept").select("row.*")
