"""The queries op1 to op13 and the pipeline: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, decontam, divergence, hamming, jaccard, mixing, oracles, pii, quality, secrets, suffix, tokens, urls, warc, whitening


def vocabulary(name: str) -> str:
    """A public vocabulary's file; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(common.table(spark, sf_dir, "documents"))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(common.table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_near(common.table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(common.table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the document that a page's article is say whether the page is blocked."""
    pages, docs, labels = (common.table(spark, sf_dir, t) for t in ("pages", "documents", "labels"))
    return urls.judge(pages, urls.labels_of_pages(pages, docs, labels))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    index = warc.write(common.table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(common.table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings"))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.link(common.table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_pii, op3_fertility, op4_jaccard_join, op5_suffix_dedup, op6_token_counts, op7_url_rules, op8_warc, op9_secrets, op10_decontamination, op11_whitening, op12_near_dedup, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
