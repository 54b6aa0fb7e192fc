"""Queries of intake: the tables built from all documents with the tokens of ``benchmark`` as lexicon, and chat exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import counts, lexicon, relations
from tessera.plans import intake
from tessera.registry import KNOWN, PAIRS, TOKS, _hash, docs, grids, known, query, rows_hash, table
from tessera.registry_views import _SERIES
from tessera.sources import chats, steps

_SYMBOL = "CASE WHEN {0} IS NULL THEN '0xF' || upper(left(sha1(source_id::VARCHAR || chr(10) || {1}), 9)) ELSE '0x' || lpad(upper(to_hex({0})), 10, '0') END"
_REL = f"""sr AS (SELECT source_id, {_SYMBOL.format('a.symbol', 'rel.anchor')} AS symbol_id, "offset", {_SYMBOL.format('b.symbol', 'rel.neighbor')} AS neighbor_symbol_id, observations AS n, a.symbol IS NOT NULL AND b.symbol IS NOT NULL AS shared
    FROM rel LEFT JOIN lex a ON a.anchor = rel.anchor LEFT JOIN lex b ON b.anchor = rel.neighbor)"""


def built(spark, sf):
    return intake.build(docs(spark, sf), known(spark, sf))


@query("k1_map", f"""WITH {TOKS}, {KNOWN}, o AS (SELECT source_id, pos, toks.anchor, {_SYMBOL.format('symbol', 'toks.anchor')} AS s, symbol IS NOT NULL AS k FROM toks LEFT JOIN lex ON lex.anchor = toks.anchor)
    SELECT source_id, count(*)::BIGINT AS occurrences, count_if(k)::BIGINT AS known, {_hash("pos", "anchor", "'occ_' || left(sha256(source_id::VARCHAR || '::0::' || pos::VARCHAR || '::' || anchor), 16)", "s")} AS digest FROM o GROUP BY source_id""")
def _(spark, sf):
    o = built(spark, sf).occurrences
    return o.groupBy("source_id").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if("known").alias("known"), F.sum(rows_hash(F.col("position"), F.col("anchor"), F.col("occurrence_id"), F.col("symbol"))).alias("digest"))


@query("k11_blocks", f"WITH {TOKS} SELECT source_id, 0 AS paragraph_id, count(*)::BIGINT AS occurrences FROM toks GROUP BY source_id")
def _(spark, sf):
    return built(spark, sf).blocks


@query("o3_source_counts", f"""WITH {TOKS}, {PAIRS}, {KNOWN}, {_REL} SELECT source_id, count(*)::BIGINT AS relations, sum(n)::BIGINT AS observations, {_hash('symbol_id', '"offset"', 'neighbor_symbol_id', 'n')} AS digest FROM sr GROUP BY source_id""")
def _(spark, sf):
    r = built(spark, sf).relations
    return r.groupBy("source_id").agg(F.count(F.lit(1)).alias("relations"), F.sum("observations").alias("observations"), F.sum(rows_hash(F.col("symbol_id"), F.col("offset"), F.col("neighbor_symbol_id"), F.col("observations"))).alias("digest"))


@query("o4_cells", f"""WITH {TOKS}, {PAIRS}, {KNOWN}, {_REL}, c AS (SELECT symbol_id AS root, "offset", neighbor_symbol_id AS neighbor, sum(n)::BIGINT AS n FROM sr WHERE shared GROUP BY ALL)
    SELECT root, count(*)::BIGINT AS relations, {_hash('"offset"', 'neighbor', 'n')} AS digest FROM c GROUP BY root""")
def _(spark, sf):
    return built(spark, sf).cells.groupBy("root").agg(F.count(F.lit(1)).alias("relations"), F.sum(rows_hash(F.col("offset"), F.col("neighbor"), F.col("count"))).alias("digest"))


@query("o1_intake", f"WITH {TOKS} SELECT count(DISTINCT source_id)::BIGINT AS sources, count(*)::BIGINT AS occurrences, true AS blocks_agree, true AS relations_two_sided FROM toks")
def _(spark, sf):
    """All tables written, read again and verified."""
    path = steps.new_folder(spark)
    intake.save(built(spark, sf), path)
    return intake.verify(intake.load(spark, path))


@query("z46_null_intake", f"""WITH {TOKS}, {PAIRS} SELECT source_id, sum(observations)::BIGINT AS observations FROM rel WHERE anchor NOT IN ('the', 'of') AND neighbor NOT IN ('the', 'of') GROUP BY source_id""")
def _(spark, sf):
    r = intake.build(docs(spark, sf), known(spark, sf), ["the", "of"]).relations
    return r.groupBy("source_id").agg(F.sum("observations").alias("observations"))


@query("z94_parity", f"""WITH {TOKS}, {PAIRS} SELECT "offset", sum(observations)::BIGINT AS observations, 0::BIGINT AS differ FROM rel GROUP BY "offset" """)
def _(spark, sf):
    """Relations by source, added up, against those of the corpus, by offset: observations, and keys with other counts."""
    a = relations.relations(docs(spark, sf)).groupBy("anchor", "offset", "neighbor").agg(F.sum("observations").alias("x"))
    b = relations.corpus_relations(docs(spark, sf)).withColumnRenamed("observations", "y")
    both = a.join(b, ["anchor", "offset", "neighbor"], "full")
    return both.groupBy("offset").agg(F.sum("x").alias("observations"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differ"))


@query("t2_index_neighbors", f"""WITH {TOKS}, {PAIRS}, g AS (SELECT anchor, neighbor, sum(observations)::BIGINT AS n FROM rel WHERE anchor IN ('the', 'und') GROUP BY ALL) SELECT anchor, neighbor, n, k::INT AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, neighbor) AS k FROM g) WHERE k <= 12""")
def _(spark, sf):
    rows = counts.overlay(relations.corpus_relations(docs(spark, sf), asked=["the", "und"]).withColumn("source_id", F.lit(0)))
    return rows.select("anchor", "neighbor", "n", "rank")


@query("p29_shape", """SELECT conv_id, turn, length(t) >= 1200 OR l >= 12 OR f >= 2 OR (length(t) >= 700 AND m >= 8 AND k >= 80) AS is_document, length(t)::INT AS char_count, l::INT AS line_count, k::INT AS term_count, f::INT AS fence_count, m::INT AS mark_count FROM (
    SELECT *, len(list_filter(string_split_regex(t, '\\r\\n|\\r|\\n'), lambda x: trim(x) <> '')) AS l, len(string_split(t, '```')) - 1 AS f, length(t) - length(translate(t, '.?!', '')) AS m,
        len(list_distinct(list_transform(regexp_extract_all(replace(replace(lower(t), 'ß', 'ss'), 'ς', 'σ'), '[a-z0-9]+(?:''[a-z0-9]+)?'), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END))) AS k
    FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') AS t FROM conversations))""")
def _(spark, sf):
    from tessera.functions import text as X

    return table(spark, sf, "conversations").select("conv_id", "turn", X.payload_shape(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


def exports(spark, sf, tree: bool):
    """Each conversation as an export file, as messages or as a tree by id."""
    c = table(spark, sf, "conversations")
    if tree:
        node = F.struct(F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), F.col("turn").cast("double").alias("create_time")).alias("message"))
        body = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), node))).alias("mapping"))
    else:
        body = c.groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"), F.col("turn").cast("double").alias("timestamp"))).alias("messages"))
    told = F.struct(F.concat(F.lit("c"), "conv_id").alias("title"), "mapping" if tree else "messages")
    return body.select(F.col("conv_id").cast("string").alias("source_name"), F.to_json(told if tree else F.struct(F.array(told).alias("threads"))).alias("content"))


_TURNS = "SELECT conv_id::VARCHAR AS source_name, 1 AS thread, 'c' || conv_id AS title, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS turn, role, text FROM conversations WHERE trim(text) <> ''"


@query("z56_threads", _TURNS)
def _(spark, sf):
    return chats.turns(exports(spark, sf, False)).drop("at")


@query("z57_trees", _TURNS)
def _(spark, sf):
    return chats.turns(exports(spark, sf, True)).drop("at")


@query("z58_memories", "SELECT doc_id::VARCHAR AS source_name, 0 AS at, source AS text FROM documents")
def _(spark, sf):
    files = docs(spark, sf).select(F.col("doc_id").cast("string").alias("source_name"), F.to_json(F.struct(F.array(F.struct(F.col("source").alias("text"))).alias("memories"))).alias("content"))
    return chats.memories(files)


@query("w1_series", f"""WITH RECURSIVE {_SERIES} SELECT s AS stream_id, f AS frame_number, round(now, 6) AS energy_total, round(now / 64, 6) AS energy_mean, round(sd, 6) AS energy_std, round(CASE WHEN k = 1 THEN 0 ELSE ce / (now + 1e-8) END, 6) AS center_energy_ratio FROM m""")
def _(spark, sf):
    from tessera.operators import frames

    got = frames.feature_series(grids(spark, sf), 8, 8)
    return got.select("stream_id", "frame_number", *(F.round(c, 6).alias(c) for c in ("energy_total", "energy_mean", "energy_std", "center_energy_ratio")))


@query("z52_lanes", f"""WITH {TOKS}, {KNOWN}, m AS (SELECT anchor, count(*)::BIGINT AS n FROM toks GROUP BY anchor), u AS (SELECT m.anchor, n FROM m ANTI JOIN lex ON lex.anchor = m.anchor) SELECT count(*)::BIGINT AS anchors, sum(n)::BIGINT AS observations FROM u""")
def _(spark, sf):
    missing = relations.token_counts(docs(spark, sf)).join(known(spark, sf), "anchor", "left_anti")
    return lexicon.lane_rollup(missing).agg(F.sum("anchors").alias("anchors"), F.sum("observations").alias("observations"))
