"""License scan: ordered signature rules over the word stream of each text.

A text becomes a stream of lower-case words. A rule is tried only where all its
keywords are among the text's words; its matches are word intervals. A detection is
suppressed when its interval lies inside that of a rule of a smaller level, or of the
same level and longer, or equally long and listed earlier. Detections of the base
phrases (level 0) always stay. The rules are a fixed list (``license_rules``);
documents are independent rows, so nothing is shuffled.

Defined cases: NULL, empty and word-less texts have no words and no detections;
repeated rows are scanned alike; key columns may have any type and name; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StringType,
                               StructField, StructType)

from talentscope.llm.arrow_rows import map_texts
from talentscope.llm.license_rules import RULES, Rule
from talentscope.llm.trie_search import terms_of

DETECTION = StructType([
    StructField("label", StringType()), StructField("level", IntegerType()),
    StructField("sure", IntegerType()), StructField("start", LongType()),
    StructField("words", LongType()), StructField("kept", BooleanType())])
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("level", pa.int32()), ("sure", pa.int32()),
                             ("start", pa.int64()), ("words", pa.int64()), ("kept", pa.bool_())]))


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        self.rules = [(r, re.compile(r.pattern.encode())) for r in rules]
        self.needs = [{w.encode() for w in r.needs} for r in rules]
        self.keywords = frozenset().union(*self.needs)
        shared = defaultdict(int)
        for need in self.needs:
            for w in need:
                shared[w] += 1
        #: keyword -> rules, each under the keyword that fewest rules have
        self.gate = defaultdict(list)
        for i, need in enumerate(self.needs):
            self.gate[min(sorted(need), key=shared.__getitem__)].append(i)

    def scan(self, words: list[bytes]) -> list[tuple]:
        """(rule number, first word, words) of every match."""
        here = self.keywords.intersection(words)
        tried = sorted(i for w in here if w in self.gate for i in self.gate[w]
                       if self.needs[i] <= here)
        if not tried:
            return []
        stream = b" " + b"  ".join(words) + b" "
        opens, out = None, []
        for i in tried:
            for m in self.rules[i][1].finditer(stream):
                if opens is None:
                    opens = np.flatnonzero(np.frombuffer(stream, dtype=np.uint8) == 32)[::2]
                out.append((i, int(np.searchsorted(opens, m.start())), m.group().count(b" ") // 2))
        return out

    def detections(self, words: list[bytes]) -> list[dict]:
        """Every match by place, with whether it is kept."""
        found = self.scan(words)
        stays = unsuppressed([(self.rules[i][0].level, s, n, i) for i, s, n in found])
        return [{"label": r.label, "level": r.level, "sure": r.sure, "start": s, "words": n, "kept": k}
                for (s, n, _), r, k in sorted(((s, n, i), self.rules[i][0], k)
                                              for (i, s, n), k in zip(found, stays))]


def unsuppressed(found: list[tuple[int, int, int, int]]) -> list[bool]:
    """Whether each (level, first word, words, rule) is not suppressed by another one."""
    order = sorted(range(len(found)), key=lambda k: (found[k][0], found[k][1], -found[k][2], found[k][3]))
    out = [True] * len(found)
    starts: list[int] = []          # of all smaller levels, with the running maximum of ends
    reach: list[int] = []
    at = 0
    while at < len(order):
        level, far, same = found[order[at]][0], -1, []
        while at < len(order) and found[order[at]][0] == level:
            _, s, n, _ = found[order[at]]
            below = bisect_right(starts, s)
            if level > 0:
                out[order[at]] = far < s + n and not (below and reach[below - 1] >= s + n)
            far = max(far, s + n)
            same.append((s, s + n))
            at += 1
        merged = sorted([*zip(starts, reach), *same])
        starts, reach, far = [], [], -1
        for s, e in merged:
            far = max(far, e)
            starts.append(s)
            reach.append(far)
    return out


def license_detections(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``n_words`` and ``detections`` (by place: label, level, sure, start,
    words, kept) of every row."""
    def make():
        scanner = Scanner()

        def fn(texts):
            split = [terms_of(t) for t in texts]
            return {"n_words": pa.array([len(w) for w in split], pa.int64()),
                    "detections": pa.array([scanner.detections(w) for w in split], _ARROW)}
        return fn
    schema = StructType([StructField("n_words", LongType()),
                         StructField("detections", ArrayType(DETECTION))])
    own = docs.select(F.struct(*(F.col(f"`{k}`") for k in keys)).alias("row"),
                      F.col(f"`{text}`").alias("t"))
    out = map_texts(own, ["row"], "t", schema, make)
    return out.select(*(F.col(f"row.`{k}`") for k in keys), "n_words", "detections")


def digests(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word (of base phrases), base_labels,
    labels (base ones and those of kept detections) and score (the surest kept one)."""
    base = F.filter("detections", lambda d: d["level"] == 0)
    kept = F.filter("detections", lambda d: d["kept"])

    def joined(rows):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda d: d["label"]))), ",")
    return found.select(
        *(F.col(f"`{k}`") for k in keys), "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(kept).alias("labels"),
        (F.coalesce(F.array_max(F.transform(kept, lambda d: d["sure"])), F.lit(0)) / 100).alias("score"))
