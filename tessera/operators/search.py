"""Search: passages by token hits and proximity, chat messages by terms, history and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import anchors, search_terms, surfaces


def _places(anchors: Column, token: str) -> Column:
    return F.filter(F.transform(anchors, lambda a, i: F.when(a == token, i)), lambda p: p.isNotNull())


def _shortest(starts: Column, others: list[Column]) -> Column:
    def span(start: Column) -> Column:
        near = [F.array_min(F.transform(o, lambda p: F.struct(F.abs(p - start).alias("d"), p.alias("p"))))["p"] for o in others]
        return F.greatest(start, *near) - F.least(start, *near) + 1

    return F.array_min(F.transform(starts, span))


def proximity_span(anchors: Column, query: list[str]) -> Column:
    """The shortest span that starts at a hit of one query token and takes in the nearest hit of each other one; null for
    fewer than two query tokens or where one is missing. Of two equally near hits the first counts."""
    wanted = list(dict.fromkeys(query))
    if len(wanted) < 2:
        return F.lit(None).cast("int")
    places = {w: _places(anchors, w) for w in wanted}
    best = [_shortest(places[w], [places[o] for o in wanted if o != w]) for w in wanted]
    every = F.lit(True)
    for w in wanted:
        every = every & (F.size(places[w]) > 0)
    return F.when(every, F.least(*best))


def evidence(blocks: DataFrame, query: list[str], per_source: int = 8, k: int = 12, proximity: bool = True) -> DataFrame:
    """source_id, block_id, hits, score: blocks by hundred points a token hit, hit density and closeness."""
    own = blocks.withColumn("__s", surfaces(F.col("text"))).withColumn("anchors", anchors(F.col("__s"))).drop("__s")
    distinct = F.array_distinct("anchors")
    hits = F.array_sort(F.array_intersect(distinct, F.array(*map(F.lit, dict.fromkeys(query)))))
    rows = own.withColumns({"hits": hits, "n": F.greatest(F.lit(1), F.size(distinct))}).where(F.size("hits") > 0)
    score = F.size("hits") * 100 + F.size("hits") / F.col("n")
    if proximity:
        score = score + F.coalesce(F.greatest(F.lit(0.0), 90.0 - proximity_span(F.col("anchors"), query) * 12), F.lit(0.0))
    rows = rows.withColumn("score", F.round(score, 6))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("score"), "block_id"))).where(F.col("r") <= per_source)
    return rows.orderBy(F.desc("score"), "source_id", "block_id").limit(k).select("source_id", "block_id", F.array_join("hits", " ").alias("hits"), "score")


def chat_search(messages: DataFrame, query: str, match: str = "all", limit: int = 50, text_col: str = "text", order: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Messages that hold all (or any) of the query's terms, by score, then in order."""
    spark = messages.sparkSession
    terms = spark.range(1).select(search_terms(F.lit(query)).alias("t")).first().t
    if not terms:
        return messages.withColumns({"score": F.lit(0), "hit_terms": F.lit("")}).limit(0)
    hay = search_terms(F.col(text_col))
    hits = F.array_intersect(F.array(*map(F.lit, terms)), hay)
    n = F.size(hits)
    score = n * 100 + F.least(F.lit(50), n) - F.least(F.lit(25), F.floor(F.greatest(F.lit(0), F.size(hay) - n) / 12))
    rows = messages.withColumns({"score": score.cast("long"), "hit_terms": F.array_join(hits, " ")})
    rows = rows.where(n == len(terms) if match == "all" else n > 0)
    return rows.orderBy(F.desc("score"), *order).limit(limit)


def history(messages: DataFrame, last: int, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last messages of each group."""
    r = F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))
    return messages.withColumn("__r", r).where(F.col("__r") <= last).drop("__r")


def excerpt(text: Column, terms: list[str], before: int = 180, after: int = 320) -> Column:
    """The text round the first term that occurs."""
    at = F.coalesce(*(F.nullif(F.locate(t.lower(), F.lower(text)), F.lit(0)) for t in terms), F.lit(1))
    return F.substring(text, F.greatest(F.lit(1), at - before), F.lit(before + after))


def conversation_turns(messages: DataFrame) -> DataFrame:
    """Turns renumbered from 1 within each conversation, missing times last."""
    r = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last()))
    return messages.withColumn("turn_no", r)


def force_answer(text: Column) -> Column:
    """F = m a from a mass in kg and an acceleration in m/s2 named in the text, as a decimal; null if either lacks."""
    mass = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*(?:kg|kilograms?)\b", 1)
    acc = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*(?:m/s\^?2|m/s²|meters? per second squared)", 1)
    return F.when((mass != "") & (acc != ""), mass.cast("decimal(18,6)") * acc.cast("decimal(18,6)"))


def transcripts(messages: DataFrame) -> DataFrame:
    """conv_id, transcript: each conversation's messages in order, one a line with its role."""
    line = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line), "\n").alias("transcript"))


def row_hashes(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with the SHA-256 of some columns, and its first twelve digits."""
    full = F.sha2(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in cols)).cast("binary"), 256)
    return rows.withColumn("hash", full).withColumn("short", F.substring("hash", 1, 12))


def spans(tokens: DataFrame, query: list[str], keys: list[str], at: str = "position") -> DataFrame:
    """keys, span: ``proximity_span`` of long texts from token rows. Only hits are kept; each finds the nearest hit of every
    other query token before and after it by windows, so the work grows with the hits."""
    wanted = list(dict.fromkeys(query))
    if len(wanted) < 2:
        return tokens.select(*keys, F.lit(None).cast("int").alias("span")).limit(0)
    hits = tokens.where(F.col("anchor").isin(wanted)).select(*keys, F.col(at).alias("p"), "anchor")
    order = W.partitionBy(*keys).orderBy("p")
    back, ahead = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    near = []
    for w in wanted:
        own = F.when(F.col("anchor") == w, F.col("p"))
        a, b = F.last(own, True).over(back), F.first(own, True).over(ahead)
        near.append(F.when(F.col("anchor") == w, F.col("p")).otherwise(F.when(b.isNull() | (F.col("p") - a <= b - F.col("p")), a).otherwise(b)).alias(f"__{len(near)}"))
    rows = hits.select(*keys, *near)
    full = rows.where(" and ".join(f"__{i} is not null" for i in range(len(wanted))))
    every = [F.col(f"__{i}") for i in range(len(wanted))]
    return full.groupBy(*keys).agg(F.min(F.greatest(*every) - F.least(*every) + 1).cast("int").alias("span"))


def citation(source: Column, block: Column, first: Column, last: Column) -> Column:
    """source (block b, line n) or (block b, lines n-m); without lines only the block."""
    lines = F.when(first == last, F.format_string(", line %d", first)).otherwise(F.format_string(", lines %d-%d", first, last))
    return F.concat(source.cast("string"), F.format_string(" (block %d", block), F.when((first > 0) & (last > 0), lines).otherwise(""), F.lit(")"))


def evidence_order(passages: DataFrame, chosen: Column, candidate: Column, heading: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Passages with ``place``: first the chosen fact's, then those of candidates, then others that aren't headings; headings
    go unless chosen or a candidate's."""
    rank = F.when(chosen, 0).when(candidate, 1).when(~heading, 2)
    rows = passages.withColumn("__k", rank).where(F.col("__k").isNotNull())
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("__k", *order))).drop("__k")


def last_days(rows: DataFrame, at: str, days: int = 7) -> DataFrame:
    """Rows of the last days up to the latest one."""
    top = rows.agg(F.max(F.to_date(at)).alias("__top"))
    return rows.join(F.broadcast(top), F.to_date(at) > F.date_sub("__top", days)).drop("__top")  # one row


def preview(rows: DataFrame, keys: list[str], order: list[str], count: int = 12) -> DataFrame:
    """The first rows of each group."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= count).drop("__r")
