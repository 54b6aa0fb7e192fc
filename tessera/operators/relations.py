"""Token tables and the positional band join: which token stands how far from which, how often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import acronym_letters, anchors, eligible, kind, paragraphs, surfaces

RADIUS = 6


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt over the cores where the scan has fewer splits than there are cores, so one row group isn't one task.

    Only rows as they are read are moved, before anything is derived from them; a scan with splits enough isn't touched, nor
    is what has been shuffled before. With ``keys`` rows are dealt by them in any case, to as many partitions as the session
    shuffles to (twice the cores at least): what is later grouped by these keys and others needs no shuffle. The number is
    explicit, since a text grows some thirtyfold in pairs and small texts would otherwise be put together again.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if keys:
        return df.repartition(max(cores * 2, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # asking for its splits would run it
        return df
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def _texts(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("source_id"), F.col(text_col).alias("text"))
    return spread(rows, "source_id") if whole else spread(rows)


def paragraph_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """source_id, paragraph_id (from 0) and the token identities of each paragraph as an array. ``whole``: dealt by source."""
    parts = _texts(docs, id_col, text_col, whole).select("source_id", F.posexplode_outer(paragraphs(F.col("text"))).alias("paragraph_id", "text")).where(F.col("text").isNotNull())
    return parts.select("source_id", "paragraph_id", surfaces(F.col("text")).alias("s")).select("source_id", "paragraph_id", anchors(F.col("s")).alias("anchors"))


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each token: source_id, paragraph_id, position, anchor, surface, kind, count_eligible."""
    parts = spread(docs.select(F.col(id_col).alias("source_id"), F.col(text_col).alias("text"))).select("source_id", F.posexplode_outer(paragraphs(F.col("text"))).alias("paragraph_id", "text")).where(F.col("text").isNotNull())
    read = parts.select("source_id", "paragraph_id", surfaces(F.col("text")).alias("surface"), acronym_letters(F.col("text")).alias("letter"))
    zipped = F.arrays_zip(anchors(F.col("surface")).alias("anchor"), F.col("surface"), F.col("letter"))
    rows = read.select("source_id", "paragraph_id", F.posexplode_outer(zipped).alias("position", "t")).where(F.col("t").isNotNull()).select("source_id", "paragraph_id", "position", "t.*")
    return rows.select("source_id", "paragraph_id", "position", "anchor", "surface", kind(F.col("anchor"), F.col("surface"), F.col("letter")).alias("kind"), eligible(F.col("surface")).alias("count_eligible"))


def placed_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """source_id, paragraph_id, position, anchor, count_eligible: token_rows without surfaces and kinds, at half the work."""
    rows = paragraph_anchors(docs, id_col, text_col).select("source_id", "paragraph_id", F.posexplode_outer("anchors").alias("position", "anchor")).where(F.col("anchor").isNotNull())
    return rows.withColumn("count_eligible", eligible(F.col("anchor")))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """anchor, n over all documents; tokens never reach across a line end, so paragraphs aren't cut."""
    read = spread(docs.select(F.col(text_col).alias("text"))).select(surfaces(F.col("text")).alias("s"))
    return read.select(F.explode_outer(anchors(F.col("s"))).alias("anchor")).where(F.col("anchor").isNotNull()).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))


def band(rows: DataFrame, keys: list[str], counted, array_col: str = "anchors", radius: int = RADIUS, asked: list[str] | None = None) -> DataFrame:
    """keys, left, distance, right, n for all pairs of counted elements of an array at distance 1..radius; with ``asked``, of
    pairs that have one of these at an end, and arrays without any aren't laid out.

    Only pairs to the right are laid out and counted; ``both_ways`` adds the mirror image after aggregation, which halves
    what is shuffled. Elements that aren't counted keep their place. Positions and partners come from two generators in
    one stage of generated code, so a pair is a row only on its way into the partial aggregation. Generators here are outer
    ones: for an inner one the optimizer adds a filter on the array's size, which works the whole text out once more.
    """
    x = F.col(array_col)
    rows = rows.where(F.arrays_overlap(x, F.array(*map(F.lit, asked)))) if asked else rows
    left = rows.select(*keys, x, F.posexplode_outer(x).alias("__at", "left")).where(F.col("left").isNotNull() & counted(F.col("left")))
    partners = F.inline(F.array(*(F.struct(F.lit(d).alias("distance"), F.get(x, F.col("__at") + d).alias("right")) for d in range(1, radius + 1))))
    pairs = left.select(*keys, "left", partners)
    pairs = pairs.where(F.col("left").isin(asked) | F.col("right").isin(asked)) if asked else pairs
    return pairs.where(F.col("right").isNotNull() & counted(F.col("right"))).groupBy(*keys, "left", "distance", "right").agg(F.count(F.lit(1)).alias("n"))


def both_ways(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, anchor, offset, neighbor, observations from one-sided pair counts."""
    side = F.explode(F.array(*(F.struct(F.col(a).alias("anchor"), (F.col("distance") * s).cast("int").alias("offset"), F.col(b).alias("neighbor")) for a, b, s in (("left", "right", 1), ("right", "left", -1)))))
    return pairs.select(*keys, side.alias("s"), F.col("n").alias("observations")).select(*keys, "s.anchor", "s.offset", "s.neighbor", "observations")


def relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, whole: bool = True, asked: list[str] | None = None) -> DataFrame:
    """source_id, anchor, offset, neighbor, observations; windows end at paragraphs. With ``asked``, of these anchors alone: other
    pairs are dropped before they are counted.

    Texts are dealt by source, which moves the text once and no pair ever; ``whole=False`` is for ids that hold a large
    share of all text, whose pairs are counted where they are read and then shuffled.
    """
    return _of(both_ways(band(paragraph_anchors(docs, id_col, text_col, whole), ["source_id"], eligible, radius=radius, asked=asked), ["source_id"]), asked)


def _of(rel: DataFrame, asked: list[str] | None) -> DataFrame:
    return rel.where(F.col("anchor").isin(asked)) if asked else rel


def corpus_relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, asked: list[str] | None = None) -> DataFrame:
    """anchor, offset, neighbor, observations over all documents, without a per-document step in between; ``asked`` as above."""
    return _of(both_ways(band(paragraph_anchors(docs, id_col, text_col), [], eligible, radius=radius, asked=asked), []), asked)


def resolved_relations(paragraphs_df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """As relations(), from rows (source_id, anchors, resolved, eligible arrays): the root is the resolved token, the
    neighbour the observed one, so both are kept until the sides are laid out. '__NULL__' roots are no roots or neighbours."""
    rows = paragraphs_df.select("source_id", F.arrays_zip("anchors", "resolved", "eligible").alias("toks"))
    pairs = band(rows, ["source_id"], lambda t: t.eligible & (t.resolved != "__NULL__"), "toks", radius)
    side = F.explode(F.array(F.struct(F.col("left.resolved").alias("anchor"), F.col("distance").cast("int").alias("offset"), F.col("right.anchors").alias("neighbor")), F.struct(F.col("right.resolved").alias("anchor"), (-F.col("distance")).cast("int").alias("offset"), F.col("left.anchors").alias("neighbor"))))
    flat = pairs.select("source_id", side.alias("s"), "n").select("source_id", "s.*", "n")
    return flat.groupBy("source_id", "anchor", "offset", "neighbor").agg(F.sum("n").alias("observations"))


def line_relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Relations whose windows end at lines."""
    lines = _texts(docs, id_col, text_col, True).select("source_id", F.explode(F.split(F.col("text"), "\r\n|\r|\n")).alias("text"))
    rows = lines.select("source_id", surfaces(F.col("text")).alias("s")).select("source_id", anchors(F.col("s")).alias("anchors"))
    return both_ways(band(rows, ["source_id"], eligible), ["source_id"])


def stream_relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Relations whose windows cross paragraphs: a document is one stream."""
    rows = _texts(docs, id_col, text_col, True).select("source_id", surfaces(F.col("text")).alias("s")).select("source_id", anchors(F.col("s")).alias("anchors"))
    return both_ways(band(rows, ["source_id"], eligible), ["source_id"])


def sequence_relations(stream: DataFrame, radius: int = RADIUS, piece: int = 4096) -> DataFrame:
    """Relations of a symbol stream (stream_id, ordinal, symbol, lane, flags, starts, blocked): a start opens a sequence;
    blocked symbols keep their place. Keys also carry the neighbour's lane and flags and the root's lane.

    Ordinals of a stream are consecutive. A stream is cut into pieces of ``piece`` records, each with the ``radius`` records
    after it, so a long stream is many small groups.
    """
    at = F.floor(F.col("ordinal") / piece)
    own = F.explode(F.array_compact(F.array(at, F.when((F.col("ordinal") % piece < radius) & (at > 0), at - 1)))).alias("piece")
    cut = stream.select("stream_id", own, F.struct("ordinal", "symbol", "lane", "flags", "starts", "blocked").alias("t"))
    rows = cut.groupBy("stream_id", "piece").agg(F.array_sort(F.collect_list("t")).alias("toks"))
    left = rows.select("piece", "toks", F.posexplode("toks").alias("__at", "left")).where((F.floor(F.col("left.ordinal") / piece) == F.col("piece")) & ~F.col("left.blocked"))

    def partner(d: int) -> Column:
        right, opened = F.get("toks", F.col("__at") + d), F.lit(False)
        for j in range(1, d + 1):
            opened = opened | F.coalesce(F.get("toks", F.col("__at") + j)["starts"], F.lit(True))
        return F.struct(F.lit(d).alias("distance"), F.when(~opened & ~right.blocked, right).alias("right"))

    pairs = left.select("left", F.inline(F.array(*map(partner, range(1, radius + 1))))).where(F.col("right").isNotNull())
    one = pairs.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in ("symbol", "lane", "flags")), "distance")
    n = one.groupBy(*one.columns).agg(F.count(F.lit(1)).alias("n"))

    def side(a: str, b: str, sign: int) -> Column:
        return F.struct(F.col(f"{a}_symbol").alias("root"), F.col(f"{a}_lane").alias("root_lane"), (F.col("distance") * sign).cast("int").alias("offset"), F.col(f"{b}_symbol").alias("neighbor"), F.col(f"{b}_lane").alias("lane"), F.col(f"{b}_flags").alias("flags"))

    return n.select(F.explode(F.array(side("left", "right", 1), side("right", "left", -1))).alias("s"), "n").select("s.*", "n").groupBy("root", "root_lane", "offset", "neighbor", "lane", "flags").agg(F.sum("n").alias("count"))
