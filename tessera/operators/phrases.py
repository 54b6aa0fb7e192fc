"""Phrase mining: n-grams of token streams with occurrence, source and boundary statistics, and their scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import anchors, casefold, surfaces
from tessera.operators.relations import spread

# Words that join others rather than carry content.
GLUE = "a an and are as at be by for from how in is it of on or that the this to what when where which who why with".split()


def surface_token(a: Column) -> Column:
    """A token that may stand in a phrase: not null, no temporary symbol (u and seven more), some letter or digit."""
    return (a != "__null__") & ~(a.startswith("u") & (F.char_length(a) >= 8)) & a.rlike(r"[\p{L}\p{N}]")


def glue_only(words: Column) -> Column:
    """Whether an n-gram holds nothing but words that join others."""
    return F.size(F.array_except(words, F.array(*map(F.lit, GLUE)))) == 0


#: Tokens that can't stand in a phrase, between single blanks; what ``surface_token`` says of one token.
_NOT_SURFACE = r"(?<![^ ])(?:__null__|u[^ ]{7,}|[^\p{L}\p{N} ]+)(?![^ ])"


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """source_id and the case-folded phrase tokens of each text."""
    read = spread(docs.select(F.col(id_col).alias("source_id"), F.col(text_col).alias("text"))).select("source_id", surfaces(F.col("text")).alias("s"))
    folded = casefold(F.array_join(anchors(F.col("s")), " "))
    kept = F.trim(F.regexp_replace(F.regexp_replace(folded, _NOT_SURFACE, ""), " +", " "))
    return read.select("source_id", kept.alias("k")).select("source_id", F.when(F.col("k") == "", F.array().cast("array<string>")).otherwise(F.split("k", " ")).alias("stream"))


def ngrams(stream_rows: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """One row for each occurrence of an n-gram that isn't all glue: source_id, phrase, n, left, right.

    A position meets its few spans in a second generator of the same stage, so the stream itself is never copied.
    """
    x, at = F.col("stream"), F.col("i")
    begun = stream_rows.select("source_id", x, F.posexplode_outer("stream").alias("i", "w")).where(F.col("w").isNotNull())
    content = lambda j: ~F.get(x, at + j).isin(GLUE)

    def span(n: int) -> Column:
        some = content(0)
        for j in range(1, n):
            some = some | content(j)
        phrase = F.when((at + n <= F.size(x)) & some, F.array_join(F.slice(x, at + 1, F.lit(n)), " "))
        return F.struct(phrase.alias("phrase"), F.lit(n).alias("n"), F.coalesce(F.get(x, at + n), F.lit("<END>")).alias("right"))

    left = F.coalesce(F.get(x, at - 1), F.lit("<START>")).alias("left")
    rows = begun.select("source_id", left, F.inline(F.array(*map(span, range(low, high + 1)))))
    return rows.where(F.col("phrase").isNotNull()).select("source_id", "phrase", "n", "left", "right")


def candidates(grams: DataFrame, min_count: int = 2) -> DataFrame:
    """phrase, n, occurrences, sources, stability: the share of the commonest left and right neighbours, added.

    Rare phrases go before boundaries are counted, so the histograms only hold what is reported.
    """
    total = grams.groupBy("phrase", "n").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("source_id").alias("sources")).where(F.col("occurrences") >= min_count)
    side = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("w")), F.struct(F.lit("r").alias("side"), F.col("right").alias("w"))))
    edge = grams.join(total.select("phrase"), "phrase", "left_semi").select("phrase", side.alias("e")).groupBy("phrase", "e").agg(F.count(F.lit(1)).alias("c"))
    modes = edge.groupBy("phrase", "e.side").agg(F.max("c").alias("c")).groupBy("phrase").agg(F.sum("c").alias("modes"))
    return total.join(modes, "phrase").select("phrase", "n", "occurrences", "sources", F.round(F.col("modes") / F.col("occurrences"), 6).alias("stability"))


#: Positions that a task counts at once; a pair of words that stands more often is still counted at once.
BLOCK_ROWS = 1 << 18


def mined(stream_rows: DataFrame, low: int = 2, high: int = 5, min_count: int = 2) -> DataFrame:
    """What ``candidates`` says of ``ngrams``, with one shuffle of a row a position: all n-grams that begin at a position go where
    its first two words go, so each is counted, with its sources and neighbours, in the one task that has all its places.

    A task holds the rows of one pair of words at least (some 50 bytes each), so ``low`` is 2 or more.
    """
    if low < 2:
        raise ValueError("n-grams of one word don't have the two that they are dealt by")
    x, at = F.col("stream"), F.col("i")
    begun = stream_rows.select("source_id", x, F.posexplode_outer("stream").alias("i", "w")).where(F.col("w").isNotNull() & F.get(x, at + 1).isNotNull())
    rows = begun.select(F.xxhash64("w", F.get(x, at + 1)).alias("key"), "source_id", F.coalesce(F.get(x, at - 1), F.lit("<START>")).alias("left"), F.array_join(F.slice(x, at + 1, F.lit(high + 1)), " ").alias("words"))
    dealt = rows.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_keys(batches, BLOCK_ROWS):
            yield from _counted(block, low, high, min_count)

    got = dealt.mapInArrow(run, "phrase string, n int, occurrences long, sources long, modes long")
    return got.select("phrase", "n", "occurrences", "sources", F.round(F.col("modes") / F.col("occurrences"), 6).alias("stability"))


def _whole_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` as tables of ``least`` rows or more that end where a key ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= least:
            key = batch.column("key").to_numpy()
            last = held[-1].column("key")[-1].as_py()
            cut = int(np.searchsorted(key, last, "right"))
            if cut < len(key):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct code a place, the number of each row's code, and how often each is there."""
    order = np.argsort(codes)
    begins = np.concatenate([[True], np.diff(codes[order]) != 0])
    of = np.empty(len(codes), np.int64)
    of[order] = np.cumsum(begins) - 1
    at = np.flatnonzero(begins)
    return order[at], of, np.diff(np.append(at, len(codes)))


def _most(of: np.ndarray, with_: np.ndarray, groups: int) -> np.ndarray:
    """How often the commonest ``with_`` stands in each group."""
    wide = int(with_.max()) + 1
    pair = np.sort(of * wide + with_)
    at = np.flatnonzero(np.concatenate([[True], np.diff(pair) != 0]))
    out = np.zeros(groups, np.int64)
    np.maximum.at(out, pair[at] // wide, np.diff(np.append(at, len(pair))))
    return out


def _counted(block: pa.Table, low: int, high: int, min_count: int) -> Iterator[pa.RecordBatch]:
    """Phrases of a block that holds all places of its pairs of words: phrase, n, occurrences, sources, modes."""
    split = pc.split_pattern(block.column("words").combine_chunks(), " ")
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    every = pa.chunked_array([split.flatten().cast(pa.string()), block.column("left").combine_chunks().cast(pa.string()), pa.array(["<END>"])]).combine_chunks().dictionary_encode()
    codes, names = every.indices.to_numpy(zero_copy_only=False).astype(np.int64), every.dictionary
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    words, left, end, wide = codes[: int(size.sum())], codes[int(size.sum()) : -1], codes[-1], len(names)
    glue = pc.is_in(names, value_set=pa.array(GLUE)).to_numpy(zero_copy_only=False)
    source = block.column("source_id").combine_chunks().dictionary_encode().indices
    source = pc.fill_null(source, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(size >= 2)
    of = words[begin[at]]
    blank = glue[of]
    for n in range(2, high + 1):
        some = size[at] >= n
        at, of, blank = at[some], of[some], blank[some]
        if not len(at):
            return
        word = words[begin[at] + n - 1]
        first, of, count = _groups(of * wide + word)
        blank = blank & glue[word]
        # A longer phrase doesn't stand more often than its beginning.
        often = count[of] >= min_count
        numbers = np.cumsum(count >= min_count) - 1
        at, blank, of, first, count = at[often], blank[often], numbers[of[often]], at[first[count >= min_count]], count[count >= min_count]
        if not len(at):
            return
        if n < low:
            continue
        told = ~blank[_first_of(of, len(count))]
        if not told.any():
            continue
        right = np.where(size[at] > n, words[np.minimum(begin[at] + n, len(words) - 1)], end)
        known = source[at] >= 0
        pair = np.unique(of[known] * (int(source.max()) + 1) + source[at][known]) // (int(source.max()) + 1) if known.any() else np.empty(0, np.int64)
        sources = np.bincount(pair, minlength=len(count))
        modes = _most(of, left[at], len(count)) + _most(of, right, len(count))
        text = pc.binary_join_element_wise(*(names.take(pa.array(words[begin[first[told]] + j])) for j in range(n)), " ")
        yield pa.RecordBatch.from_arrays(
            [text, pa.array(np.full(int(told.sum()), n, np.int32)), pa.array(count[told].astype(np.int64)), pa.array(sources[told].astype(np.int64)), pa.array(modes[told].astype(np.int64))],
            names=["phrase", "n", "occurrences", "sources", "modes"],
        )


def _first_of(of: np.ndarray, groups: int) -> np.ndarray:
    """A row of each group."""
    out = np.zeros(groups, np.int64)
    out[of] = np.arange(len(of))
    return out


def scored(found: DataFrame) -> DataFrame:
    """The eight score parts added up, and the kind of candidate."""
    words = F.split("phrase", " ")
    glue = F.size(F.filter(words, lambda w: w.isin(GLUE)))
    content = F.col("n") - glue
    edges = F.element_at(words, 1).isin(GLUE).cast("int") + F.element_at(words, -1).isin(GLUE).cast("int")
    score = (
        F.col("occurrences") * 2.0 + F.col("sources") * 3.0 + F.col("n") * 1.5 + content / F.col("n") + F.col("stability")
        + F.when(glue == F.col("n"), glue * -1.25).otherwise(glue * -0.25) + edges * -4.0 + F.when(content <= 1, -3.0).otherwise(0.0)
    )
    kind = F.when(glue == 0, "concept").when(edges > 0, "director_or_structure").otherwise("concept_with_director")
    return found.withColumns({"score": F.round(score, 6), "kind": kind})
