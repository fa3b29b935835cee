"""The queries of the training-data operators over the driver's tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, dedup, fill_in_middle, language_model, mixing, packing, pii, quality_model, quality_rules, toxicity, url_filter, warc, winnowing
from .common import Scratch, table
from .oracles import ORACLES


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base, spans = F.col("pii.base"), F.col("pii.spans")
    counts = [_count(base, k).alias(f"n_{name}") for k, name in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


def _count(spans, kind: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=~quality_model.held_out())
    return out.select("doc_id", quality_model.held_out().alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), f"{Scratch(spark, 'archives').root}/pages")


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), train=~language_model.held_out())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=~toxicity.held_out())
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.neighbours(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        winnowing.digest(F.col("own")).alias("fingerprint"),
        winnowing.digest(F.col("changed")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        winnowing.likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.size("own").cast("long").alias("n_fingerprints"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
    return rows.select("doc_id", *[F.col(f"rules.{k}").alias(k) for k in names])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fim = F.col("fim")
    digest = lambda text: F.sha2(text, 256)
    return fill_in_middle.transform(table(spark, sf_dir, "documents")).select(
        "doc_id",
        fim["n"].alias("n"),
        fim["form"].alias("form"),
        fim["prefix_chars"].alias("prefix_chars"),
        fim["middle_chars"].alias("middle_chars"),
        digest(fim["output"]).alias("output_sha256"),
        digest(fill_in_middle.restored(fim["output"], fim["form"])).alias("restored_sha256"),
    )


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "filter.*")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_context_mixing": op5_context_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_winnowing": op7_winnowing,
    "op8_minhash": op8_minhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_url_filter": op12_url_filter,
    "op13_collocations": op13_collocations,
}

__all__ = ["ORACLES", "QUERIES"]
