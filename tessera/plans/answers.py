"""Answers from documents: evidence passages, facts in them, and a walk over the passages' own relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relations import corpus_relations
from tessera.operators.search import evidence
from tessera.plans.walk import Walk, answer_walk


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("source_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("block_id", "text")).where("text <> ''")


def facts(passages: DataFrame, query: list[str]) -> DataFrame:
    """source_id, block_id, fact, score: question-answer pairs and sentences of passages, best first."""
    pairs = F.regexp_extract_all("text", F.lit(r"(?is)Answer:\s*(.+?)(?=\s*Question:|$)"), F.lit(1))
    sentences = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.size(F.split(s, r"\s+")) >= 3)
    kind = F.size(pairs) > 0
    rows = passages.select("source_id", "block_id", "score", kind.alias("qa"), F.explode(F.when(kind, pairs).otherwise(sentences)).alias("fact"))
    low = F.split(F.lower("fact"), r"[^\p{L}\p{N}']+")
    hits = F.size(F.array_intersect(low, F.array(*map(F.lit, query))))
    total = hits * 100 + F.col("score") / 10 + F.when(F.col("qa"), 50).otherwise(0)
    return rows.select("source_id", "block_id", F.trim("fact").alias("fact"), F.round(total, 6).alias("score")).orderBy(F.desc("score"), "source_id", "block_id", "fact")


def document_answer(docs: DataFrame, query: list[str], steps: int = 8) -> tuple[DataFrame, DataFrame, Walk]:
    """Passages (twelve at most), facts and the walk over the passages."""
    own = blocks(docs)
    found = evidence(own, query)
    passages = own.join(F.broadcast(found), ["source_id", "block_id"])  # twelve rows at most
    rel = corpus_relations(passages.select(F.concat_ws("/", "source_id", "block_id").alias("doc_id"), "text"))
    return passages, facts(passages, query), answer_walk(rel, query, steps)
