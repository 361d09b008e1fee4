"""Corpus pipeline over ``documents``: quality rules, near-duplicate groups,
repeated passages, benchmark decontamination, token ids.

Every stage takes (spark, docs, sf_dir), with ``docs`` the rows that the stage
before kept, and returns the columns of ``documents``; the last adds ``n_tokens``
and ``ids``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.llm import decontaminate, ngram_join, quality_rules, sentencepiece_bpe, suffix_dedup
from talentscope.llm.common import discard, discard_noted, noting, staged, table
from talentscope.llm.queries import tokenizer_path


#: Folders and tables that the stages called so far staged for themselves.
_spent: list[str] = []


def stage(fn):
    """A stage. Its predecessors' results are written and reread by the time it is
    called, so it first removes what they staged, except what ``docs`` itself reads."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _spent[:] = discard_noted(spark, _spent, docs)
        with noting() as made:
            out = fn(spark, docs, sf_dir)
        _spent.extend(made)
        return out
    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.filter_quality(docs)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one of smallest id stays."""
    return ngram_join.keep_one_per_group(docs)


@stage
def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that a document of smaller id has too are cut."""
    return suffix_dedup.dedup(docs)


@stage
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut; documents that consist mostly of them go."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


@stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(docs, tokenizer_path()).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_passage_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", token_stage),
]
#: Merge rounds and byte cuts have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written as
    Parquet to the shared folder and reread as the next one's input, and removed when
    that one's are written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, apply) in enumerate(STAGES):
        before, docs = docs, staged(apply(spark, docs, sf_dir), f"stage{i}")
        if i:
            discard(before)
    _spent[:] = discard_noted(spark, _spent, docs)
    return docs
