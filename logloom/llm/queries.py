"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import digest, langid, mixing, packing, pii, quality, rules, sharding, simhash, substrings
from logloom.llm.tables import table


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; held-out documents teach nothing."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", quality.held_out())
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    return quality.predict(docs, quality.fitted(docs, labels), ["doc_id", "held_out"])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    placed = packing.assign(packing.pieces(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as drawn, with rate, copy and shuffle_key."""
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op7_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return digest.neighbours(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; held-out documents teach nothing."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    return langid.predict(docs, langid.fitted(docs.where("not held_out")), ("doc_id", "held_out"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of every document."""
    return pii.report(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base_failed and kept of every document."""
    docs = table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.fitted(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_digest": op7_digest,
    "op8_langid": op8_langid,
    "op9_pii": op9_pii,
    "op10_rules": op10_rules,
}

ORACLES: dict[str, str] = {
    "op3_sharding": sharding.oracle(),
    "op6_mixing": mixing.oracle(),
}
