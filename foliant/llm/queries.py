"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, fim, html, langid, linedup, neardup, passages, pieces, quality, resample, secrets, toxicity, warc
from foliant.llm.shared import release

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


#: A public model of 32,000 pieces, unless the session names another in spark.foliant.pieceModel.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def piece_model(spark: SparkSession) -> str:
    return spark.conf.get("spark.foliant.pieceModel", PIECE_MODEL)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, piece_model(spark), ["doc_id"])


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = neardup.components(docs)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.quality_rules(docs).select("doc_id", *counts, "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    chain = toxicity.train(docs.withColumnRenamed("doc_id", "id"), labels)
    return toxicity.score(docs, chain, ["doc_id"])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.predict(rows, model, ["doc_id", "held_out"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    return decontam.leaks(docs, items).withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = linedup.dedup_lines(docs)
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.update_ledger(docs)
    return secrets.digest(secrets.findings(docs, ledger).drop("text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return passages.repeated_passages(docs).withColumnRenamed("id", "doc_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return fim.transform(table(spark, sf_dir, "documents"), ["doc_id"], columns=columns)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.records(table(spark, sf_dir, "pages"))
    folder = warc.archive_folder(spark)
    written = warc.write(rows, folder)
    found = warc.read(written)
    warc.remove(spark, folder)
    release(written)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_html_extraction, op2_sentencepiece, op3_minhash_neardup, op4_quality_rules, op5_toxicity, op6_language_id, op7_decontamination, op8_line_dedup, op9_secret_scan, op10_substring_dedup, op11_fill_in_middle, op12_warc, op13_resample)}
