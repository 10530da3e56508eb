"""The corpus pipeline over ``documents``: its stages in order, each over all that the one before kept.

Every stage but the last returns the columns of ``documents`` and decides row by row: rows that
share a doc_id, or have none, are judged by themselves. Null texts count as empty. Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontam, langid, neardup, pieces, pii
from lexloom.llm.common import Scratch, crc_mod, table
from lexloom.llm.queries import PIECE_MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the others carry the language that was found."""
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return langid.accepted(docs, model).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (similarity 0.8 or more) stays, the one with the smallest
    doc_id; a null doc_id comes last, and of rows that repeat one any single row. Texts without words are no copies."""
    # the numbered rows are written, so that a row keeps its number whatever runs again
    rows = Scratch(spark).save(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    groups = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), percent=80).select(F.col("doc_id").alias("row"), "component_id")
    by_id = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(F.min(by_id).alias("x")).select("x.row")
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go."""
    return decontam.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes a mark of its kind; n_chars follows the text."""
    return pii.redacted(docs).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, text_crc32 and whether the ids decode to the text."""
    return pieces.encoded(spark, docs, PIECE_MODEL)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

#: Language models, tagger and lattice have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
