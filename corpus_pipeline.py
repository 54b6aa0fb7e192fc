"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
applies them in order and writes what each returns to the shared folder before the next begins. A document without an id
passes every stage that doesn't look at its text; null texts become empty in the line stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_dedup import drop_repeated_lines
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.pieces import encode_documents
from tessera.llm.store import stash
from tessera.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain calls toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that ten or more documents hold; n_chars follows the text."""
    kept = drop_repeated_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five words, similarity 0.8).

    Rows are told apart by id and text, so an unlike text under a repeated id stays; of several rows of a group's smallest id
    one stays. Documents without words or id are no group's.
    """
    found = stash(near_duplicates(docs, shingle=5, percent=80))
    several = found.where("kept and group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("c"), F.min("text_hash").alias("h"), F.min("doc_id").alias("doc_id")).where("c > 1")
    more = found.where("kept").join(several.select("group_id", "h"), "group_id").where("text_hash <> h")
    dropped = found.where("not kept").select("doc_id", "text_hash").unionByName(more.select("doc_id", "text_hash")).distinct()
    left = docs.withColumn("text_hash", F.xxhash64("text")).join(dropped, ["doc_id", "text_hash"], "left_anti")
    if several.limit(1).count():
        same = several.select("doc_id", F.col("h").alias("text_hash"))
        left = left.join(same, ["doc_id", "text_hash"], "left_anti").unionByName(left.join(same, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return left.select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item (five words, similarity 0.8)."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    return encode_documents(docs.select("doc_id", "text"), decoded_col="decoded").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", benchmark), ("SentencePiece", sentencepiece)]

#: SQL has no classifier chain and no SentencePiece; tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs)
    return docs
