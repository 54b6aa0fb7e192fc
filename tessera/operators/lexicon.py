"""The lexicon: known and missing tokens, symbols, lanes of unknown ones, near spellings, assignment and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.symbols import allocated, local_symbol, symbol_hex, temp_symbol
from tessera.functions.text import casefold, letter_bucket
from tessera.sources.steps import settled

# The lanes in order, and the surfaces that belong to some of them.
LANES = ["unknown_real_word_candidates", "math_terms_or_symbols", "math_markup", "domain_notation_anchors", "structural_source_anchors", "source_id_artifacts", "source_cleanup_candidates", "null_symbol_anchors"]
MATH_MARKUP = "annotation columnalign mathvariant mathsize menclose mfenced mfrac mi mn mo mover mroot mrow mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover rowalign semantics stretchy".split()
MATH_TERMS = "absolute arccosine arcsine arctangent asymptote binomial coefficient cosine cotangent cosecant derivative determinant divisor ellipse exponent exponential factorial fraction function hyperbola integral intercept logarithm matrix multiplication numerator parabola polynomial quadratic radical secant sine subscript summation superscript tangent trinomial variable vector".split()
MATH_SYMBOLS = "+ - − – × ÷ · ⋅ ∙ = ≠ ≈ ≡ ≟ ≤ ≥ ∞ π θ α β γ δ ε λ μ µ ν ρ σ ω ψ χ Σ Δ ∆ ∫ ∑ ∪ ∩ √ ∘ ∠ ℓ ℳ ∼ ′ ¯ ° ± → ⟶ ⇌ 〈 〉".split()
STRUCTURE = "alt class cnxml colname colnum colsep colspec data display document eip entry fs gif href id idm jpeg jpg mdml nameend namest newline ost pdf png resource rowsep src svg target tbody tgroup thead tbl tif tiff type valign webp xmlns ⓐ ⓑ ⓒ ⓓ ⓔ ⓕ".split()
CLEANUP = "columnalign mathsize mathvariant rowalign".split()
ABBREVIATIONS = "aques03s ctques rques sques".split()
NOTATION = "csc gcf hcl ln sec sqrt".split()
MOJIBAKE = ["â", "Ã", "Â", "Î", "Ï", "ð"]


def lane(anchor: Column, context: Column | None = None) -> Column:
    """The lane of a token the lexicon lacks; the first test that fits decides. Context in prose frees markup words."""
    s = F.trim(F.coalesce(anchor, F.lit("")))
    low = casefold(s)
    held = F.coalesce(context, F.lit("")) if context is not None else F.lit("")
    prose = (held != "") & ~casefold(held).rlike("[<>]|m:|mathml")
    markup = s.contains("<") | s.contains(">") | s.contains('="') | s.contains("m:")
    source = low.rlike(r"(?:^|[_-])(?:ch\d+|mod\d+|fig(?:ure)?|table|review_questions|self_check_questions|critical_thinking_questions|problem|solution)(?:$|[_-])") | low.rlike(r"^(?:[a-z]+)?\d+[a-z]*(?:[_-][a-z0-9]+)+$")
    word = (F.char_length(s) >= 3) & s.rlike(r"^\p{L}(?:[\p{L}'’‘]*\p{L})$")
    garbled = F.lit(False)
    for p in MOJIBAKE:
        garbled = garbled | s.startswith(p)
    return (
        F.when(s == "", LANES[7]).when(markup, LANES[7]).when(source, LANES[5]).when(low.isin(CLEANUP) & ~prose, LANES[6]).when(low.isin(ABBREVIATIONS), LANES[6])
        .when(low.isin(NOTATION), LANES[3]).when(low.isin(MATH_MARKUP), F.when(prose, LANES[0]).otherwise(LANES[2])).when(s.isin(MATH_SYMBOLS), LANES[1])
        .when(low.isin(MATH_TERMS), LANES[1]).when(low.isin(STRUCTURE), LANES[4]).when(garbled, LANES[7]).when(word, LANES[0])
        .when(~s.rlike(r"^[A-Za-z0-9_\-]+$"), LANES[7]).when(low.rlike("^[a-z][a-z'-]{2,}$"), LANES[0]).otherwise(LANES[7])
    )


def numbered(rows: DataFrame, col: str) -> DataFrame:
    """The distinct values of a column with their rank from 0. Ranks come from range partitions and their sizes, so no
    task sorts everything; partitions are written out before they are counted, so a lost executor can't deal values anew."""
    held = rows.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(col)
    part = held.withColumn("__p", F.spark_partition_id()).withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(col)))
    part = settled(part)
    sizes = part.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    base, total = [], 0
    for p, n in sorted((r["__p"], r["n"]) for r in sizes):
        base.append((p, total))
        total += n
    bases = rows.sparkSession.createDataFrame(base, "__p int, base long")
    return part.join(F.broadcast(bases), "__p").select(col, (F.col("base") + F.col("__r") - 1).alias("i"))


def allocate(anchors: DataFrame, start: int = 0) -> DataFrame:
    """anchor, symbol: symbols in order of the anchors, from an allocation index on."""
    return numbered(anchors, "anchor").select("anchor", allocated(F.col("i") + start).alias("symbol"))


def symbol_table(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(source_id, anchor) -> symbol text: the lexicon's, else one local to the source."""
    rows = tokens.select("source_id", "anchor").distinct().join(lexicon, "anchor", "left")
    return rows.select("source_id", "anchor", F.coalesce(symbol_hex(F.col("symbol")), local_symbol(F.col("source_id"), F.col("anchor"))).alias("symbol"), F.col("symbol").isNotNull().alias("known"))


def known_and_missing(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """status (known, missing), anchors, observations."""
    rows = counts.join(lexicon.select("anchor", F.lit(True).alias("k")), "anchor", "left")
    return rows.groupBy(F.when(F.col("k"), "known").otherwise("missing").alias("status")).agg(F.count(F.lit(1)).alias("anchors"), F.sum("n").alias("observations"))


def lane_rollup(unknown: DataFrame) -> DataFrame:
    """Anchors and observations of every lane, empty ones too."""
    lanes = unknown.sparkSession.createDataFrame([(x,) for x in LANES], "lane string")
    own = unknown.groupBy(lane(F.col("anchor")).alias("lane")).agg(F.count(F.lit(1)).alias("anchors"), F.sum("n").alias("observations"))
    zero = F.lit(0).cast("long")
    return lanes.join(own, "lane", "left").select("lane", F.coalesce("anchors", zero).alias("anchors"), F.coalesce("observations", zero).alias("observations"))


def _case(a: Column) -> Column:
    return F.struct(F.substring(a, 1, 1).rlike(r"^\p{Lu}").alias("first"), (F.char_length(a) - F.char_length(F.regexp_replace(a, r"\p{Lu}", ""))).alias("capitals"))


def _shorter(a: Column) -> Column:
    """A word and all that is left of it without one character."""
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(a))), lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.char_length(a)))), a))


def suggestions(missing: DataFrame, known: DataFrame) -> DataFrame:
    """anchor, suggestion: the one known anchor within an edit, of the same first letter and capitals; two equally near
    ones are none. Two words within an edit share one of what is left of them without a character, so only those that do are
    compared."""
    blocked = lambda a: [letter_bucket(a).alias("letter"), _case(a).alias("case"), F.explode(_shorter(a)).alias("part")]
    left = missing.select("anchor").distinct().where(F.col("anchor").rlike(r"\p{L}"))
    left = left.select("anchor", *blocked(F.col("anchor")))
    right = known.select(F.col("anchor").alias("other")).distinct().select("other", *blocked(F.col("other")))
    pairs = left.join(right, ["letter", "case", "part"]).where(F.col("anchor") != F.col("other")).select("anchor", "other").distinct()
    near = pairs.withColumn("d", F.levenshtein("anchor", "other", 1)).where("d >= 0")
    cost = F.struct(F.col("d"), F.abs(F.char_length("anchor") - F.char_length("other")).alias("gap"))
    ranked = near.select("anchor", "other", cost.alias("cost"))
    best = ranked.groupBy("anchor").agg(F.min("cost").alias("cost"))
    only = ranked.join(best, ["anchor", "cost"]).groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("other").alias("suggestion"))
    return only.where("c = 1").select("anchor", "suggestion")


def dedupe(entries: DataFrame, order: list[str]) -> DataFrame:
    """The first entry of each word without regard to case."""
    key = W.partitionBy(casefold(F.col("word"))).orderBy(*order)
    return entries.withColumn("__r", F.row_number().over(key)).where("__r = 1").drop("__r")


def rebuilt(packs: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(word, symbol) of all packs without regard to case, the first in ``order`` kept, and one row of checks: rows read,
    words left, duplicates, distinct symbols, symbols that aren't ten hex digits."""
    rows = dedupe(packs, order).select("word").distinct()
    numbered_rows = settled(allocate(rows.select(F.col("word").alias("anchor"))).select(F.col("anchor").alias("word"), symbol_hex(F.col("symbol")).alias("symbol")))
    seen = packs.agg(F.count(F.lit(1)).alias("source_rows"))
    own = numbered_rows.agg(F.count(F.lit(1)).alias("unique_rows"), F.count_distinct("symbol").alias("symbols"), F.count_if(~F.col("symbol").rlike("^0x[0-9A-F]{10}$")).alias("bad_symbols"))
    checks = seen.crossJoin(own)  # one row each
    return numbered_rows, checks.select("source_rows", "unique_rows", (F.col("source_rows") - F.col("unique_rows")).alias("duplicates"), "symbols", "bad_symbols")


def by_letter(words: DataFrame) -> DataFrame:
    """letter, word, place: words of a letter's file in order, case aside."""
    letter = letter_bucket(F.col("word"))
    return words.select(letter.alias("letter"), "word", F.row_number().over(W.partitionBy(letter).orderBy(F.lower("word"), "word")).alias("place"))


def letter_distribution(words: DataFrame) -> DataFrame:
    """letter, n for all 26 letters and any others that occur."""
    letters = words.sparkSession.createDataFrame([(chr(65 + i),) for i in range(26)], "letter string")
    own = words.groupBy(letter_bucket(F.col("word")).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    return letters.join(own, "letter", "full").select("letter", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def assign(requests: DataFrame, slots: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, slot: new words in order get free slots in order; none at all if slots are short."""
    new = requests.select("word").distinct().join(lexicon.select("word"), "word", "left_anti")
    want, free = new.count(), slots.count()
    if want > free:
        return new.select("word", F.lit(None).cast(slots.schema["slot"].dataType).alias("slot")).where("false")
    return numbered(new, "word").join(numbered(slots, "slot"), "i").select("word", "slot")


def review_queue(registry: DataFrame, lexicon: DataFrame, ignored: DataFrame, pending: DataFrame, min_observations: int = 1) -> DataFrame:
    """Missing anchors that are neither known nor ignored, with whether they are pending."""
    rows = registry.where(F.col("observations") >= min_observations).join(lexicon.select("anchor"), "anchor", "left_anti").join(ignored.select("anchor"), "anchor", "left_anti")
    rows = rows.join(pending.select("anchor", F.lit("pending").alias("status")), "anchor", "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("unmatched")))


def registry_upsert(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Counts added, first_seen kept, last_seen moved."""
    return registry.unionByName(seen).groupBy("anchor").agg(F.sum("observations").alias("observations"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def search(entries: DataFrame, needle: str, fields: list[str], order: list[str], limit: int = 50) -> DataFrame:
    """Entries with the needle (two characters at least) in some field, in scan order."""
    low = needle.lower()
    if len(low) < 2:
        return entries.limit(0)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(F.col(f)).contains(low), F.lit(False))
    return entries.where(hit).orderBy(*order).limit(limit)


def temp_symbols(anchors: DataFrame, version: str = "v1", rounds: int = 8) -> DataFrame:
    """source_id, anchor, symbol: temporary symbols. Where anchors of a source meet in one symbol the first keeps it and the
    others are salted anew until none meets another; after ``rounds`` that is an error."""
    todo = settled(anchors.select("source_id", "anchor").distinct())
    done = None
    for salt in range(rounds):
        drawn = todo.withColumn("symbol", temp_symbol(version, F.col("source_id"), F.col("anchor"), F.lit(salt)))
        if done is not None:
            drawn = drawn.join(done.select("source_id", "symbol", F.lit(True).alias("taken")), ["source_id", "symbol"], "left")
        else:
            drawn = drawn.withColumn("taken", F.lit(None).cast("boolean"))
        first = F.row_number().over(W.partitionBy("source_id", "symbol").orderBy("anchor")) == 1
        drawn = settled(drawn.withColumn("won", F.col("taken").isNull() & first))
        won = drawn.where("won").select("source_id", "anchor", "symbol")
        done = won if done is None else done.unionByName(won)
        todo = drawn.where("not won").select("source_id", "anchor")
        if not todo.limit(1).count():
            return done
    raise ValueError("temporary symbols still meet")


def relation_fates(rel: DataFrame, lexicon: DataFrame) -> DataFrame:
    """fate, relations, observations: whether root and neighbour are in the lexicon."""
    lex = lexicon.select("anchor", F.lit(True).alias("k"))
    rows = rel.join(lex.withColumnRenamed("k", "root_known"), "anchor", "left").join(lex.select(F.col("anchor").alias("neighbor"), F.col("k").alias("neighbor_known")), "neighbor", "left")
    word = lambda c: F.when(F.col(c), "canonical").otherwise("local")
    return rows.groupBy(F.concat_ws("-", word("root_known"), word("neighbor_known")).alias("fate")).agg(F.count(F.lit(1)).alias("relations"), F.sum("observations").alias("observations"))
