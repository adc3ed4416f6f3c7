"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

In every stage, columns of any name are passed on as they are, an empty table gives no rows, and texts of any length
are worked on whole. What each does with nulls and repeated rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import discard, documents, written
from wordloom.llm.decontamination import leaks
from wordloom.llm.jaccard_join import jaccard_rows
from wordloom.llm.language import NONE, fit, predict, remainder
from wordloom.llm.line_dedup import dedupe_lines
from wordloom.llm.packing import pack

#: A text of which no language has half of the words' probability has no language.
LEAST_SCORE = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, text, and text_id, a hash of the text: no name of a column can clash."""
    text = docs["text"].cast("string")
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_id"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter (null and empty ones too) or no language.

    Learned from the rows whose id leaves another remainder than 1, rows without an id too. If no row has a label,
    there is no language to tell, and all texts with a letter stay. Equal texts are judged alike.
    """
    rows = _packed(docs)
    field = fit(docs.filter(F.coalesce(remainder() != 1, F.lit(True))))
    if not field.labels:
        return docs.filter(docs["text"].cast("string").rlike(r"\p{L}"))
    told = predict(rows, field, keep=["row"])
    return _unpacked(told.filter((F.col("lang_pred") != NONE) & (F.col("score") >= LEAST_SCORE)), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand earlier; a document that loses all its words goes.

    Rows of null text stay as they are, and so do rows without an id, which make no others lose lines either; rows
    of one id and text lose the same lines. n_chars, if there is one, is counted anew.
    """
    out = dedupe_lines(docs)
    lost = (F.col("_n_exact") + F.col("_n_near") > 0) & ~F.col("text").rlike("[^ \\t-\\r]")
    out = out.filter(~F.coalesce(lost, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies (five words, 0.8 or more).

    Texts without words are near nothing and stay; of rows of one id and text one stays; rows without an id stay.
    """
    rows = _packed(docs)
    kept = jaccard_rows(docs, shingle=5, percent=80).filter("doc_id = component_id").select(F.col("doc_id").alias("own_id"), F.col("text_id").alias("own_text")).distinct()
    known = rows.join(kept, (F.col("doc_id") == F.col("own_id")) & (F.col("text_id") == F.col("own_text"))).dropDuplicates(["doc_id", "text_id"])
    return _unpacked(known.select("row").unionByName(rows.filter("doc_id IS NULL").select("row")), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item.

    Rows are judged by their text, whether they have an id or not: another row of a leaking one's id stays. Null and
    empty texts stay. Items of few words are no evidence (see `weak_items`).
    """
    rows = _packed(docs).withColumn("key", F.xxhash64("doc_id", "text_id"))
    found = leaks(rows.select("key", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return _unpacked(rows.select("row", "key").join(found, "key", "left_anti"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, row by row: a null or empty text is its end id, a null id stays null."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Most stages are models and joins that SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out, name)
            discard(docs)  # but the input, which is no such table
        docs = out
    return docs
