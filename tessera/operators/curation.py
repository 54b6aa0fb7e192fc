"""Curation of the lexicon: queues of missing words, their approval and assignment to slots, look-ups and review.

A queue is rows (word, frequency, status) with status unmatched, pending or ignored; slots are rows (slot, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import letter_bucket
from tessera.operators.lexicon import assign, suggestions


def recognised(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_id, anchors) -> query_id, represented, missing: the query's distinct tokens in order, in the lexicon or not."""
    own = queries.select("query_id", F.posexplode_outer(F.array_distinct("anchors")).alias("p", "anchor"))
    held = own.join(lexicon.select("anchor", F.lit(True).alias("k")).distinct(), "anchor", "left")
    part = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test & F.col("anchor").isNotNull(), F.struct("p", "anchor")))), lambda t: t.anchor)
    return held.groupBy("query_id").agg(part(F.col("k").isNotNull()).alias("represented"), part(F.col("k").isNull()).alias("missing"))


def canonical_relations(rel: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Relations whose both ends are in the lexicon."""
    lex = lexicon.select("anchor").distinct()
    return rel.where("observations > 0").join(lex, "anchor", "left_semi").join(lex.withColumnRenamed("anchor", "neighbor"), "neighbor", "left_semi")


def phrase_memberships(phrases: DataFrame, anchors: list[str]) -> DataFrame:
    """anchor, phrase_id, at: phrases (phrase_id, sequence) that hold an asked token, and its first place from 0."""
    own = phrases.select("phrase_id", "sequence", F.explode(F.array_distinct("sequence")).alias("anchor")).where(F.col("anchor").isin(anchors))
    return own.select("anchor", "phrase_id", (F.array_position("sequence", F.col("anchor")) - 1).alias("at"))


def browse(entries: DataFrame, letter: str, limit: int = 50, order: str = "word") -> DataFrame:
    """word, total: a letter's first entries and how many it has."""
    own = entries.where(letter_bucket(F.col("word")) == letter.strip().upper()[:1])
    return own.orderBy(order).limit(limit).crossJoin(own.agg(F.count(F.lit(1)).alias("total")))  # one row of totals


def recent(entries: DataFrame, count: int = 30, at: str = "mapped_at", tie: str = "word") -> DataFrame:
    return entries.where(F.col(at).isNotNull()).orderBy(F.desc(at), tie).limit(count)


def found(words: DataFrame, structural: DataFrame, canonical: DataFrame) -> DataFrame:
    """word, pack, symbol of words that have an entry; a structural one goes before a canonical one."""
    packs = structural.select("word", "symbol", F.lit("structural").alias("pack"), F.lit(0).alias("k")).unionByName(canonical.select("word", "symbol", F.lit("canonical").alias("pack"), F.lit(1).alias("k")))
    best = packs.groupBy("word").agg(F.min(F.struct("k", "symbol", "pack")).alias("e"))
    return words.select("word").distinct().join(best, "word").select("word", "e.pack", "e.symbol")


def last_symbols(entries: DataFrame, order: str = "seq") -> DataFrame:
    """word, symbol: of several rows of a word the last one's."""
    return entries.groupBy("word").agg(F.max_by("symbol", order).alias("symbol"))


def moved(queue: DataFrame, words: DataFrame, to: str, lexicon: DataFrame | None = None) -> DataFrame:
    """The queue with words in another status; a word that wasn't in it comes in with frequency 0, one in the lexicon
    doesn't."""
    asked = words.select("word").distinct()
    if lexicon is not None:
        asked = asked.join(lexicon.select(F.col("anchor").alias("word")), "word", "left_anti")
    both = queue.join(asked.withColumn("__a", F.lit(True)), "word", "full")
    return both.select("word", F.coalesce("frequency", F.lit(0).cast("long")).alias("frequency"), F.when(F.col("__a"), to).otherwise(F.col("status")).alias("status"))


def moved_all(queue: DataFrame, source: str, to: str) -> DataFrame:
    return queue.withColumn("status", F.when(F.col("status") == source, to).otherwise(F.col("status")))


def unignored(queue: DataFrame, words: DataFrame) -> DataFrame:
    """The queue without words that were ignored."""
    return queue.join(words.select("word", F.lit("ignored").alias("status")).distinct(), ["word", "status"], "left_anti")


def listed(queue: DataFrame, status: str, letter: str | None = None, limit: int = 100) -> DataFrame:
    """Words of a status, most frequent first."""
    own = queue.where(F.col("status") == status)
    if letter:
        own = own.where(F.col("word").startswith(letter.lower()[:1]))
    return own.orderBy(F.desc("frequency"), "word").limit(limit)


def free_slots(slots: DataFrame) -> DataFrame:
    return slots.where(F.upper("status") == "AVAILABLE")


def assigned_pending(queue: DataFrame, slots: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, slot: every pending word with a slot of its own, in order; none if slots are short."""
    return assign(queue.where("status = 'pending'").select("word"), free_slots(slots).select("slot"), lexicon)


def reclaimed(slots: DataFrame, entries: DataFrame) -> DataFrame:
    """The slots with those of all entries available again."""
    back = entries.where(F.col("slot").isNotNull()).select("slot", F.lit("AVAILABLE").alias("status"))
    return slots.join(back.select("slot"), "slot", "left_anti").unionByName(back)


def imported(files: DataFrame, slots: DataFrame, lexicon: DataFrame) -> DataFrame:
    """letter, bound, skipped, no_slots of word files (letter, at, word): a word counts where it comes first, by letter and
    place; one that the lexicon has is skipped; none is bound if slots are short."""
    first = files.where(F.col("word").isNotNull() & (F.col("word") != "")).groupBy("word").agg(F.min(F.struct("letter", "at")).alias("f")).select("word", "f.letter")
    got = assign(first.select("word"), free_slots(slots).select("slot"), lexicon.select(F.col("anchor").alias("word")))
    state = first.join(lexicon.select(F.col("anchor").alias("word"), F.lit("skipped").alias("had")), "word", "left").join(got.select("word", F.lit("bound").alias("new")), "word", "left")
    state = state.withColumn("s", F.coalesce("had", "new", F.lit("no_slots")))
    return state.groupBy("letter").agg(*(F.count_if(F.col("s") == s).alias(s) for s in ("bound", "skipped", "no_slots")))


def may_suggest(anchor: Column) -> Column:
    """Whether a missing token looks like a word that may be misspelt: letters with inner apostrophes or hyphens, not all
    capitals."""
    return (F.char_length(anchor) >= 3) & anchor.rlike(r"^\p{L}[\p{L}'’\-]*\p{L}$") & ~((F.upper(anchor) == anchor) & (F.lower(anchor) != anchor))


def misspelled(missing: DataFrame, lexicon: DataFrame, most: int | None = None) -> DataFrame:
    """anchor, observations, suggestion, review_kind of missing tokens; ``most``: with more of them none is suggested, as
    an interactive review wants it."""
    rows = missing.select("anchor", "observations")
    tried = rows.where(may_suggest(F.col("anchor")))
    if most is not None and rows.count() > most:
        tried = tried.where("false")
    got = rows.join(suggestions(tried, lexicon), "anchor", "left")
    return got.withColumn("review_kind", F.when(F.col("suggestion").isNotNull(), "possible_misspelling").otherwise("missing_anchor"))


def resolved(missing: DataFrame, lexicon: DataFrame, slots: DataFrame) -> DataFrame:
    """anchor, action, resolved_to: a near known spelling, else a new slot, else nothing."""
    rows = misspelled(missing, lexicon)
    new = assign(rows.where("suggestion is null").select(F.col("anchor").alias("word")), free_slots(slots).select("slot"), lexicon.select(F.col("anchor").alias("word")))
    got = rows.join(new.select(F.col("word").alias("anchor"), "slot"), "anchor", "left")
    action = F.when(F.col("suggestion").isNotNull(), "spell_corrected_to_existing").when(F.col("slot").isNotNull(), "assigned").otherwise("unresolved")
    return got.select("anchor", action.alias("action"), F.coalesce("suggestion", F.when(F.col("slot").isNotNull(), F.col("anchor"))).alias("resolved_to"))


def block_counts(tokens: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with the number of their token occurrences, also those without any."""
    own = tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    return blocks.join(own, keys, "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0).cast("long")))


def overlay_cloud(rel: DataFrame, asked: list[str], k: int = 6) -> DataFrame:
    """source_id, neighbor, n, support, rank: each source's strongest neighbours of the asked roots, with the roots that
    support them."""
    own = rel.where(F.col("anchor").isin(asked) & (F.col("observations") > 0)).groupBy("source_id", "neighbor").agg(F.sum("observations").alias("n"), F.array_sort(F.collect_set("anchor")).alias("support"))
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("n"), "neighbor")))
    return ranked.where(F.col("rank") <= k)


def null_index(tokens: DataFrame, nulls: DataFrame) -> DataFrame:
    """Where tokens without an anchor of their own stand: the rows of ``tokens`` whose anchor is in ``nulls``."""
    return tokens.join(nulls.select("anchor").distinct(), "anchor", "left_semi")


def windows(tokens: DataFrame, radius: int = 6) -> DataFrame:
    """(source_id, paragraph_id, anchors) -> one row for each occurrence with the tokens before and after it."""
    x, at = F.col("anchors"), F.col("position")
    rows = tokens.select("source_id", "paragraph_id", x, F.posexplode_outer(x).alias("position", "anchor")).where(F.col("anchor").isNotNull())
    before = F.slice(x, F.greatest(F.lit(1), at - radius + 1), F.least(at, F.lit(radius)))
    return rows.select("source_id", "paragraph_id", "position", "anchor", before.alias("before"), F.slice(x, at + 2, F.lit(radius)).alias("after"))
