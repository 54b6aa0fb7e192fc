"""Further queries by operator; same helpers as ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import symbols as S
from tessera.functions import text as X
from tessera.operators import counts, frames, graph, lexicon, phrases, relations, visual
from tessera.registry import _CELL_SQL, _hash, _FOLD, _GLUE_SQL, _GRAMS, _QUESTION_SQL, COUNTS, KNOWN, PAIRS, QUESTION, TOKS, _tokens, docs, grids, known, query, rows_hash, table


@query("p1_paragraphs", r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n', chr(10), 'g'), '\r', chr(10), 'g'), '\n\s*\n+'), lambda p: trim(p, ' ' || chr(9) || chr(10)) <> ''))::INT AS paragraphs FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.paragraphs(F.col("text"))).alias("paragraphs"))


@query("p5_literals", r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '\S+'), lambda r: length(r) >= 32 AND regexp_matches(r, '\p{L}') AND regexp_matches(r, '\p{Nd}')))::INT AS literals FROM documents""")
def _(spark, sf):
    runs = F.regexp_extract_all(F.col("text"), F.lit(r"(\S+)"), F.lit(1))
    return docs(spark, sf).select("doc_id", F.size(F.filter(runs, X.is_literal)).alias("literals"))


@query("p6_acronyms", r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '\p{L}+'), lambda p: length(p) >= 2 AND upper(p) = p))::INT AS acronyms FROM documents""")
def _(spark, sf):
    runs = F.regexp_extract_all(F.col("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    return docs(spark, sf).select("doc_id", F.size(F.filter(runs, X.is_acronym)).alias("acronyms"))


@query("p10_atomic", f"""WITH {KNOWN}, ba AS (SELECT row_number() OVER (ORDER BY anchor) AS aid, anchor AS text FROM lex), {_tokens("ba", "aid", "tk")} SELECT ba.text AS anchor, string_agg(tk.anchor, ' ' ORDER BY pos) AS atoms FROM ba JOIN tk ON tk.source_id = ba.aid GROUP BY ba.text""")
def _(spark, sf):
    return relations.placed_anchors(table(spark, sf, "benchmark"), "item_id").select("anchor").distinct().select("anchor", F.array_join(X.atomic(F.col("anchor")), " ").alias("atoms"))


@query("p12_inventory", f"WITH {TOKS} SELECT source_id, count(*)::BIGINT AS tokens, count(DISTINCT anchor)::BIGINT AS kinds, count_if(eligible)::BIGINT AS counted FROM toks GROUP BY source_id")
def _(spark, sf):
    return relations.placed_anchors(docs(spark, sf)).groupBy("source_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("anchor").alias("kinds"), F.count_if("count_eligible").alias("counted"))


@query("p13_leaders", "SELECT doc_id, regexp_replace(text, '[─-╿]+', ' ', 'g') AS text FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.strip_leaders(F.col("text")).alias("text"))


@query("p15_cells", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.collapse(F.col("text")).alias("text"))


@query("p17_letters", r"""SELECT doc_id, CASE WHEN regexp_extract(lower(source), '\p{L}') = '' THEN 'A' ELSE upper(regexp_extract(lower(source), '\p{L}')) END AS letter FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.letter_bucket(F.col("source")).alias("letter"))


@query("p18_occurrences", f"WITH {TOKS} SELECT source_id, pos AS position, anchor, 'occ_' || left(sha256(source_id::VARCHAR || '::0::' || pos::VARCHAR || '::' || anchor), 16) AS occurrence_id FROM toks")
def _(spark, sf):
    rows = relations.placed_anchors(docs(spark, sf))
    return rows.select("source_id", F.col("position").cast("long").alias("position"), "anchor", X.stable_id("occ", F.col("source_id"), F.col("paragraph_id"), F.col("position"), F.col("anchor")).alias("occurrence_id"))


@query("p25_clean", r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.clean_text(F.col("text")).alias("text"))


@query("j2_symbol_relations", f"""WITH {TOKS}, {PAIRS}, {KNOWN} SELECT a.symbol AS symbol_id, "offset", b.symbol AS neighbor_symbol_id, sum(observations)::BIGINT AS observations
    FROM rel JOIN lex a ON a.anchor = rel.anchor JOIN lex b ON b.anchor = rel.neighbor GROUP BY ALL""")
def _(spark, sf):
    lex = known(spark, sf)
    rel = relations.corpus_relations(docs(spark, sf))
    both = rel.join(lex.withColumnRenamed("symbol", "symbol_id"), "anchor").join(lex.select(F.col("anchor").alias("neighbor"), F.col("symbol").alias("neighbor_symbol_id")), "neighbor")
    return both.groupBy("symbol_id", "offset", "neighbor_symbol_id").agg(F.sum("observations").alias("observations"))


@query("j7_stream_relations", f"""WITH {TOKS}, {PAIRS} SELECT source_id, count(*)::BIGINT AS relations, sum(observations)::BIGINT AS observations, {_hash('anchor', '"offset"', 'neighbor', 'observations')} AS digest FROM rel GROUP BY source_id""")
def _(spark, sf):
    return relations.stream_relations(docs(spark, sf)).groupBy("source_id").agg(F.count(F.lit(1)).alias("relations"), F.sum("observations").alias("observations"), F.sum(rows_hash(F.col("anchor"), F.col("offset"), F.col("neighbor"), F.col("observations"))).alias("digest"))


_LINES = "ln AS (SELECT doc_id * 1000000 + generate_subscripts(string_split(text, chr(10)), 1) AS lid, unnest(string_split(text, chr(10))) AS text FROM documents)"


@query("g2_line_relations", f"""WITH {_LINES}, {_tokens("ln", "lid", "toks")}, {PAIRS}, f AS (SELECT source_id // 1000000 AS source_id, anchor, "offset", neighbor, sum(observations) AS n FROM rel GROUP BY ALL)
    SELECT source_id, count(*)::BIGINT AS relations, sum(n)::BIGINT AS observations, {_hash('anchor', '"offset"', 'neighbor', 'n')} AS digest FROM f GROUP BY source_id""")
def _(spark, sf):
    return relations.line_relations(docs(spark, sf)).groupBy("source_id").agg(F.count(F.lit(1)).alias("relations"), F.sum("observations").alias("observations"), F.sum(rows_hash(F.col("anchor"), F.col("offset"), F.col("neighbor"), F.col("observations"))).alias("digest"))


@query("j13_two_hop", f"""WITH {TOKS}, {PAIRS}, s AS (SELECT anchor, neighbor, sum(observations)::BIGINT AS n FROM rel WHERE anchor IN ({_QUESTION_SQL}) GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, neighbor) AS k FROM s),
    r AS (SELECT neighbor AS anchor FROM f WHERE k <= 32 GROUP BY neighbor ORDER BY sum(n) DESC, neighbor LIMIT 128), w AS (SELECT anchor FROM r UNION SELECT unnest([{_QUESTION_SQL}]))
    SELECT anchor, sum(n)::BIGINT AS observations, {_hash('"offset"', 'neighbor', 'n')} AS digest FROM (SELECT anchor, "offset", neighbor, sum(observations) AS n FROM rel WHERE anchor IN (SELECT anchor FROM w) GROUP BY ALL) GROUP BY anchor""")
def _(spark, sf):
    d = docs(spark, sf)
    roots = [r.anchor for r in counts.two_hop_roots(relations.corpus_relations(d, asked=QUESTION), QUESTION).collect()]  # 131 at most
    near = relations.corpus_relations(d, asked=roots)
    return near.groupBy("anchor").agg(F.sum("observations").alias("observations"), F.sum(rows_hash(F.col("offset"), F.col("neighbor"), F.col("observations"))).alias("digest"))


@query("h5_grid", f"""WITH {KNOWN} SELECT anchor, list_sum(list_transform(range(40), lambda k: (symbol >> k) & 1))::BIGINT AS ones, (symbol % 256)::BIGINT AS low FROM lex""")
def _(spark, sf):
    bits = S.grid_bits(F.col("symbol"))
    low = F.aggregate(F.slice(bits, 33, 8), F.lit(0).cast("long"), lambda a, b: a * 2 + b)
    return known(spark, sf).select("anchor", F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b).alias("ones"), low.alias("low"))


@query("h6_temp_symbols", f"""WITH {TOKS} SELECT DISTINCT source_id, anchor, 'U' || upper(left(sha256('v1::' || source_id::VARCHAR || '::' || anchor || '::0'), 11)) AS symbol FROM toks""")
def _(spark, sf):
    return lexicon.temp_symbols(relations.placed_anchors(docs(spark, sf))).select("source_id", "anchor", "symbol")


@query("h8_phrase_ids", f"""WITH {TOKS}, {_GRAMS} SELECT phrase, '0x' || upper(left(sha256(array_to_string(g, chr(31)) || chr(30) || array_to_string(g, chr(31))), 10)) AS phrase_id FROM cand""")
def _(spark, sf):
    words = F.split("phrase", " ")
    return phrases.mined(phrases.streams(docs(spark, sf))).select("phrase", S.phrase_id(words, words).alias("phrase_id"))


@query("j19_align", r"""WITH a AS (SELECT lang AS doc, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS norm, doc_id AS ordinal FROM documents),
    b AS (SELECT lang AS doc, lower(trim(regexp_replace(coalesce(string_split(text, chr(10))[1], ''), '\s+', ' ', 'g'))) AS norm, doc_id AS ordinal FROM documents),
    an AS (SELECT *, row_number() OVER (PARTITION BY doc, norm ORDER BY ordinal) AS k FROM a), bn AS (SELECT *, row_number() OVER (PARTITION BY doc, norm ORDER BY ordinal) AS k FROM b),
    j AS (SELECT coalesce(an.doc, bn.doc) AS doc, an.ordinal AS s, bn.ordinal AS v FROM an FULL JOIN bn ON an.doc = bn.doc AND an.norm = bn.norm AND an.k = bn.k)
    SELECT doc, count(s)::BIGINT AS source_items, count(v)::BIGINT AS seen_items, count_if(s IS NOT NULL AND v IS NOT NULL)::BIGINT AS "exact",
           round(count_if(s IS NOT NULL AND v IS NOT NULL) / greatest(count(s), count(v), 1), 6) AS ratio FROM j GROUP BY doc""")
def _(spark, sf):
    """Whole texts against the first lines of all texts."""
    rows = table(spark, sf, "documents").select(F.col("lang").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("ordinal"))
    return visual.agreement(visual.align(rows, rows.withColumn("text", F.get(F.split("text", "\n"), F.lit(0)))))


@query("w11_clean", "SELECT label::VARCHAR AS stream_id, vec_id AS frame_number, round(list_sum(embedding::DOUBLE[]), 6) AS screen_energy FROM embeddings")
def _(spark, sf):
    return frames.clean_vector(grids(spark, sf)).select("stream_id", "frame_number", F.round("screen_energy", 6).alias("screen_energy"))


@query("w13_upsample", f"WITH {_CELL_SQL} SELECT stream_id, frame_number, round(4 * sum(x), 5) AS total, 256::BIGINT AS n FROM c GROUP BY ALL")
def _(spark, sf):
    up = frames.upsample(grids(spark, sf), 8, 8, 2)
    return up.select("stream_id", "frame_number", F.round(F.aggregate("cells", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("cells").cast("long").alias("n"))


@query("a23_verify", f"WITH {TOKS} SELECT count(*)::BIGINT AS rows_n, count(DISTINCT anchor)::BIGINT AS kinds, (count(*) - count(DISTINCT anchor))::BIGINT AS duplicates FROM toks")
def _(spark, sf):
    rows = relations.placed_anchors(docs(spark, sf))
    return rows.agg(F.count(F.lit(1)).alias("rows_n"), F.count_distinct("anchor").alias("kinds"), (F.count(F.lit(1)) - F.count_distinct("anchor")).alias("duplicates"))


@query("z2_positions", f"WITH {TOKS} SELECT anchor, min(source_id * 1000000 + pos)::BIGINT AS first_at, count(*)::BIGINT AS n FROM toks GROUP BY anchor")
def _(spark, sf):
    rows = relations.placed_anchors(docs(spark, sf)).withColumn("at", F.col("source_id") * 1000000 + F.col("position"))
    return rows.groupBy("anchor").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))


@query("p7_identity", f"SELECT doc_id, {_FOLD.format('lower(source)')} AS folded, lower(source) AS ident FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.casefold(F.col("source")).alias("folded"), X.identity(F.col("source")).alias("ident"))


@query("g3_walk")
def _(spark, sf):
    _, edges = graph.document_graph(docs(spark, sf))
    first = docs(spark, sf).agg(F.min("doc_id")).first()[0]
    return graph.walk(edges, str(first), 3, 500)


@query("i4_walk")
def _(spark, sf):
    from tessera.plans.walk import answer_walk

    rel = relations.corpus_relations(docs(spark, sf))
    walk = answer_walk(rel, ["the", "thereover", "of", "tion", "er"], steps=4)
    return spark.createDataFrame(list(enumerate(zip(walk.answer, walk.scores, strict=True))), "step int, found struct<anchor: string, score: double>").select("step", "found.*")
