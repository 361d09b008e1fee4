"""Registered queries of the operators: thin wrappers that derive the contracted columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.llm import decontaminate as D
from talentscope.llm import html_extract as H
from talentscope.llm import language_id as L
from talentscope.llm import license_scan as C
from talentscope.llm import ngram_join as N
from talentscope.llm import oracles as O
from talentscope.llm import quality_gam as G
from talentscope.llm import quality_rules as Q
from talentscope.llm import sentencepiece_bpe as S
from talentscope.llm import suffix_dedup as X
from talentscope.llm import token_alignment as A
from talentscope.llm import trie_search as T
from talentscope.llm import url_filter as U
from talentscope.llm import warc as W
from talentscope.llm.common import crc_mod, table
from talentscope.llm.registry import register

def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@register("op1_quality_gam")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = G.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return G.score_documents(docs, model, ["doc_id"]).select(
        "doc_id", held.alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@register("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return Q.quality_verdicts(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", F.round("divergence", 4).alias(
                          "divergence"))


@register("op3_url_filter", O.URL_FILTER)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    out = U.url_verdicts(pages, U.page_outcomes(pages, labels), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


@register("op4_decontaminate", O.DECONTAMINATE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                            table(spark, sf_dir, "benchmark"), ["doc_id"])
    return D.digests(found, ["doc_id"])


@register("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return S.token_digests(docs, tokenizer_path(), ["doc_id"])


@register("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return L.predict(docs, L.train(docs), ["doc_id"]).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


@register("op7_warc", O.WARC)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.page_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register("op8_suffix_dedup", O.SUFFIX_DEDUP)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op9_html_extract")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return H.extract(pages, ["page_id", "url"])


@register("op10_ngram_join", O.NGRAM_JOIN)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return N.similar_groups(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@register("op11_license_scan", O.LICENSE_SCAN)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.digests(C.license_detections(docs, ["doc_id"]), ["doc_id"])


@register("op12_ranked_search", O.RANKED_SEARCH)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.search(table(spark, sf_dir, "documents").select("doc_id", "text"),
                    table(spark, sf_dir, "benchmark"))


@register("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return A.alignment(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path())[0]
