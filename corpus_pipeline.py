"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, piece encoding.

Each stage takes (spark, docs, sf_dir) with docs in the columns of documents
and returns what it keeps, in the same columns (the last: the encoded rows).
Further columns of docs go, whatever their names; an empty table gives an
empty one; very long texts are taken whole. A row that stands twice is judged
twice, alike, and equal texts of different ids stay or go by the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, langid, linedup, neardup, pieces
from foliant.llm.queries import piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The last stage calls Python pieces; SQL can't express any stage.
ORACLE_SQL = None


def _kept(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return docs.join(ids, "doc_id", how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: not 'und', and with the share of known n-grams that langid asks for.

    Null and empty texts and those without letters are 'und' and go. A null
    doc_id is no reason to go; a null lang teaches nothing. Without any lang no
    language is known and all documents go.
    """
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs.withColumn("_text", F.col("text")), model, [*COLUMNS[:1], "_text", *COLUMNS[2:]])
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= langid.LEAST_SCORE))
    return kept.withColumnRenamed("_text", "text").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines; one that loses all its text that way goes.

    Null texts and rows with a null doc_id stay as they are: an empty or null
    text goes only if lines were removed from it. n_chars counts what is left
    (null for a null text). Rows that repeat a doc_id count as one document.
    """
    found = linedup.dedup_lines(docs.select(COLUMNS))
    left = (F.size("removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return found.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group, by doc_id.

    Null texts and texts without words are in no group and stay, and so do rows
    with a null doc_id, which are linked with nothing. Rows that repeat a
    doc_id stay or go together.
    """
    found = neardup.components(docs.select(F.col("doc_id").alias("id"), "text"))
    gone = found.filter("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return _kept(docs.select(COLUMNS), gone, "left_anti").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none and stay; so do rows with a null doc_id,
    whose finding can't be told from another's. Rows that repeat a doc_id go
    together if one of them holds an item. An empty benchmark keeps all.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("item"), "text")
    gone = decontam.leaks(docs.select(F.col("doc_id").alias("id"), "text"), items).select(F.col("id").alias("doc_id")).distinct()
    return _kept(docs.select(COLUMNS), gone, "left_anti").select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, of its best segmentation; a null or empty text has none."""
    found = pieces.encode(docs.select(COLUMNS), piece_model(spark), ["doc_id", "lang", "source", "n_chars"])
    return found.select("doc_id", "lang", "source", "n_chars", "n_pieces", "ids", "exact")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each one's result written to the shared folder and read as the next one's input."""
    from foliant.llm.shared import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
