"""Question sets of several shapes to one: question, answer, context, alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean_text, final_answer

COLUMNS = ["source_key", "question_text", "answer_text", "source_context_text", "blocked_alternatives"]


def choice(labels: Column, texts: Column, key: Column) -> Column:
    """The text at a label, else at the label read as an index from 0."""
    at = F.array_position(labels, key)
    return F.coalesce(F.when(at > 0, F.get(texts, (at - 1).cast("int"))), F.get(texts, key.try_cast("int")))


def record(rows: DataFrame, source: str, question: Column, answer: Column, context: Column | None = None, others: Column | None = None) -> DataFrame:
    """Rows of the common shape; those without a question or an answer go."""
    none = F.array().cast("array<string>")
    out = rows.select(
        F.lit(source).alias("source_key"), clean_text(question).alias("question_text"), clean_text(answer).alias("answer_text"),
        clean_text(context if context is not None else F.lit("")).alias("source_context_text"),
        (F.filter(F.transform(others, clean_text), lambda x: x != "") if others is not None else none).alias("blocked_alternatives"),
    )
    return out.where("question_text <> '' and answer_text <> ''")


def multiple_choice(rows: DataFrame, source: str) -> DataFrame:
    """question, labels, texts, answer_key."""
    right = choice(F.col("labels"), F.col("texts"), F.col("answer_key"))
    return record(rows.withColumn("__r", right), source, F.col("question"), F.col("__r"), None, F.filter("texts", lambda t: t != F.col("__r")))


def word_problems(rows: DataFrame, source: str) -> DataFrame:
    """question and a worked answer that ends in '#### result'."""
    return record(rows, source, F.col("question"), final_answer(F.col("answer")), F.col("answer"))


def spans(rows: DataFrame, source: str) -> DataFrame:
    """question, context and answers, of which the first counts."""
    return record(rows, source, F.col("question"), F.get("answers", F.lit(0)), F.col("context"))


def together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reasoning_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """(question, frame) -> row_index, question, frame: rows numbered from 0 before those without either go, so gaps stay."""
    from tessera.operators.lexicon import numbered

    at = numbered(rows.select(F.struct(*order).alias("k")), "k")
    own = rows.withColumn("k", F.struct(*order)).join(at, "k")
    return own.where((F.trim("question") != "") & (F.trim("frame") != "")).select(F.col("i").alias("row_index"), F.trim("question").alias("question"), F.trim("frame").alias("frame"))
