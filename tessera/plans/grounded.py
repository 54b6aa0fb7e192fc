"""Answers grounded in passages, for many questions at once, and the cascade that decides who answers a message.

Passages are found by shared content tokens; each gives facts (answers of question-answer pairs, compact answer fields, else its own
text), scored by the question's tokens and the walked terms they hold. A question keeps its best fact and five more, with
the places they come from. Each tier of the cascade only sees messages that no tier before it has answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import anchors, payload_shape, surfaces
from tessera.operators import questions as Q
from tessera.operators.search import force_answer
from tessera.operators.surface import sentence

# Points for a token of the question, a walked term, and kinds of facts.
QUERY_HIT, TERM_HIT, PAIR, COMPACT = 100.0, 35.0, 75.0, 40.0
COMPACT_MARK = "Compact Answer Field"
PASSAGES, FACTS = 12, 6


def tokens_of(text: Column) -> Column:
    return anchors(surfaces(F.coalesce(text, F.lit(""))))


def passages(queries: DataFrame, blocks: DataFrame, k: int = PASSAGES) -> DataFrame:
    """query_id, source_id, block_id, hits, score, place: the k blocks (source_id, block_id, text) of each query (query_id, anchors)
    with the most content tokens of it, of equal ones those in which they are densest."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(Q.content(F.col("anchors")))).alias("anchor"))
    own = blocks.select("source_id", "block_id", F.array_distinct(tokens_of(F.col("text"))).alias("t"))
    flat = own.select("source_id", "block_id", F.size("t").alias("n"), F.explode("t").alias("anchor")).where(~Q.blocked_answer(F.col("anchor")))
    met = wanted.join(flat, "anchor").groupBy("query_id", "source_id", "block_id").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"))
    scored = met.withColumn("score", F.round(F.col("hits") * 100 + F.col("hits") / F.greatest(F.lit(1), F.col("n")), 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id", "block_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k).drop("n")


def fact_texts(text: Column) -> Column:
    """array<struct<fact, kind, told>> of a passage; told is what is looked at for hits."""
    clean = Q.cleaned(text)
    pattern = F.lit(r"Question:\s*(.+?)\s+Answer:\s*(.+?)(?=(?:\s+Question:)|$)")
    row = lambda fact, kind, told: F.struct(fact.alias("fact"), F.lit(kind).alias("kind"), told.alias("told"))
    pairs = F.zip_with(F.regexp_extract_all(clean, pattern, F.lit(1)), F.regexp_extract_all(clean, pattern, F.lit(2)), lambda q, a: row(Q.fact_text(a), "qa_answer", F.concat_ws(" ", Q.fact_text(q, 240), Q.fact_text(a))))
    pairs = F.filter(pairs, lambda p: p.fact != "")
    rest = Q.fact_text(F.regexp_extract(clean, f"{COMPACT_MARK}(.*)$", 1))
    compact = F.when(clean.contains(COMPACT_MARK) & (rest != ""), F.array(row(rest, "compact_answer", rest)))
    none = F.filter(pairs, lambda p: F.lit(False))
    told = F.concat(pairs, F.coalesce(compact, none))
    letters = F.size(F.filter(tokens_of(clean), lambda a: a.rlike(r"\p{L}")))
    whole = F.when((clean != "") & ~Q.heading_only(clean, letters) & ~Q.code_only(clean), F.array(row(Q.fact_text(clean), "source_block", Q.fact_text(clean))))
    return F.when(F.size(told) > 0, told).otherwise(F.coalesce(whole, none))


def facts(queries: DataFrame, found: DataFrame, blocks: DataFrame, k: int = FACTS) -> DataFrame:
    """query_id, rank, source_id, block_id, fact, kind, score, query_hits, term_hits: the k best facts of each query (query_id,
    anchors, terms) in its passages; rank 1 is the one that is selected. A fact needs a content token of the query, if that has any."""
    told = blocks.select("source_id", "block_id", F.explode(fact_texts(F.col("text"))).alias("f"))  # read once a block, not for each query that finds it
    told = told.select("source_id", "block_id", "f.fact", "f.kind", F.array_distinct(tokens_of(F.col("f.told"))).alias("a"), tokens_of(F.col("f.fact")).alias("b")).where(F.size("a") > 0)
    rows = found.select("query_id", "source_id", "block_id", "score", "place").join(told, ["source_id", "block_id"])
    asked = queries.select("query_id", F.array_distinct("anchors").alias("q"), F.filter(F.array_distinct("anchors"), lambda x: ~Q.blocked_answer(x)).alias("c"), F.array_distinct("terms").alias("t"))
    rows = rows.join(asked, "query_id").where((F.size("c") == 0) | F.arrays_overlap("a", "c"))
    hits, terms = F.size(F.array_intersect("a", "q")), F.size(F.array_intersect(F.array_union("a", "b"), F.col("t")))
    more = F.when(F.col("kind") == "qa_answer", PAIR).when(F.col("kind") == "compact_answer", COMPACT).otherwise(0.0)
    scored = rows.select("query_id", "source_id", "block_id", "place", "fact", "kind", F.round(hits * QUERY_HIT + terms * TERM_HIT + F.col("score") / 10.0 + more, 6).alias("score"), hits.alias("query_hits"), terms.alias("term_hits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "place", "block_id", "fact")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("place")


def grounded(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Queries (query_id, anchors, terms) -> query_id, answer, grounded, citations: the selected fact, or the sentence of the terms
    where no passage has one; citations are the places of selected and other facts, each once, in order."""
    best = facts(queries, passages(queries, blocks), blocks)
    coord = F.concat(F.col("source_id").cast("string"), F.lit(":block"), F.col("block_id").cast("string"))
    per = best.groupBy("query_id").agg(F.min_by("fact", "rank").alias("fact"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", coord.alias("c")))), lambda x: x.c)).alias("citations"))
    rows = queries.join(per, "query_id", "left")
    return rows.select("query_id", F.coalesce("fact", sentence(F.array_distinct("anchors"), F.col("terms"))).alias("answer"), F.col("fact").isNotNull().alias("grounded"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))


def routed(messages: DataFrame, documents: DataFrame, counts: DataFrame, memory: DataFrame) -> DataFrame:
    """Messages (query_id, text) -> query_id, tier, answer. The tiers in order: a payload that is a document, a formula, then the
    first of documents, counts and memory (query_id, answer) that has an answer; unanswered if none has."""
    shaped = messages.select("query_id", payload_shape(F.col("text")).alias("s"), force_answer(F.coalesce("text", F.lit(""))).alias("force"))
    first = shaped.withColumn("is_document", F.col("s.is_document"))
    payload = first.where("is_document").select("query_id", F.lit("document_payload").alias("tier"), F.lit(None).cast("string").alias("answer"))
    formula = first.where("not is_document and force is not null").select("query_id", F.lit("formula").alias("tier"), F.concat(F.regexp_replace(F.col("force").cast("string"), r"\.?0+$", ""), F.lit(" N")).alias("answer"))
    left, done = first.where("not is_document and force is null").select("query_id"), payload.unionByName(formula)
    for name, tier in (("documents", documents), ("counts", counts), ("memory", memory)):
        own = left.join(tier.where("coalesce(answer, '') <> ''").select("query_id", "answer"), "query_id").select("query_id", F.lit(name).alias("tier"), "answer")
        done, left = done.unionByName(own), left.join(own, "query_id", "left_anti")
    return done.unionByName(left.select("query_id", F.lit("unanswered").alias("tier"), F.lit(None).cast("string").alias("answer")))
