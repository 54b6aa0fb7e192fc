"""Queries by operator, each with SQL that says the same where SQL can.

The test tables have no lexicon: known anchors are the distinct tokens of ``benchmark``, symbols their rank. Frames are
``embeddings`` as 8 x 8 grids in one stream a label; the value series is ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import symbols as S
from tessera.functions import text as X
from tessera.operators import by_source, context, counts, dedupe, frames, graph, lexicon, phrases, relations, search

ASKED = ["the", "of", "de", "la", "und", "que"]
QUESTION = ["the", "and", "of"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source")


def rows_hash(*cols: Column) -> Column:
    """A row as a number of 32 bits, to be summed: equal sums over the same groups mean equal rows."""
    joined = F.concat_ws("|", *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def _hash(*cols: str) -> str:
    return f"sum(('0x' || left(md5(concat_ws('|', {', '.join(cols)})), 8))::BIGINT)::BIGINT"


def known(spark, sf):
    own = relations.placed_anchors(table(spark, sf, "benchmark"), "item_id").select("anchor").distinct()
    return lexicon.allocate(own)


def grids(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("stream_id"), F.col("vec_id").alias("frame_number"), F.col("embedding").cast("array<double>").alias("cells"))


def cell_rows(spark, sf, asked=None):
    """Relations of the sources of each lane as count cells, a key once; a source's number gives its lane. Of all roots or of those asked."""
    lane = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5
    rel = relations.relations(docs(spark, sf).select(lane.alias("doc_id"), "text"), whole=False, asked=asked)
    return rel.select(F.col("anchor").alias("root"), F.lit(0).alias("root_lane"), "offset", "neighbor", F.col("source_id").alias("lane"), F.lit(0).alias("flags"), F.col("observations").alias("count"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _tokens(source: str, key: str, out: str) -> str:
    """SQL tables for a text table: runs and tokens with positions."""
    return rf"""
    {out}_runs AS (
        SELECT id, i, r, length(r) >= 32 AND regexp_matches(r, '\p{{L}}') AND regexp_matches(r, '\p{{Nd}}') AS lit
        FROM (SELECT {key} AS id, unnest(regexp_extract_all(coalesce(text, ''), '\S+')) AS r,
                     generate_subscripts(regexp_extract_all(coalesce(text, ''), '\S+'), 1) AS i FROM {source})),
    {out}_parts AS (
        SELECT id, i, lit, CASE WHEN lit THEN [lower(r)] ELSE flatten(list_transform(regexp_extract_all(r, '\p{{L}}+|[^\s\p{{L}}]'),
               lambda p: CASE WHEN regexp_full_match(p, '\p{{L}}{{2,}}') AND upper(p) = p
                              THEN list_transform(regexp_extract_all(p, '.'), lambda c: lower(c)) ELSE [lower(p)] END)) END AS t
        FROM {out}_runs),
    {out} AS (
        SELECT id AS source_id, row_number() OVER (PARTITION BY id ORDER BY i, k) - 1 AS pos, anchor, NOT lit AS eligible
        FROM (SELECT id, i, lit, unnest(t) AS anchor, generate_subscripts(t, 1) AS k FROM {out}_parts))"""


TOKS = _tokens("documents", "doc_id", "toks")
PAIRS = """
    fwd AS (
        SELECT a.source_id, a.anchor AS l, o.o AS d, b.anchor AS r, count(*)::BIGINT AS n
        FROM (SELECT * FROM toks WHERE eligible) a CROSS JOIN (SELECT unnest(range(1, 7)) AS o) o
        JOIN (SELECT * FROM toks WHERE eligible) b ON b.source_id = a.source_id AND b.pos = a.pos + o.o
        GROUP BY ALL),
    rel AS (
        SELECT source_id, l AS anchor, d::INT AS "offset", r AS neighbor, n AS observations FROM fwd
        UNION ALL SELECT source_id, r, (-d)::INT, l, n FROM fwd)"""
KNOWN = _tokens("benchmark", "item_id", "bench") + """,
    lex AS (SELECT anchor, 68719476736 + row_number() OVER (ORDER BY anchor) - 1 AS symbol FROM (SELECT DISTINCT anchor FROM bench))"""
COUNTS = "cnt AS (SELECT anchor, count(*)::BIGINT AS n FROM toks GROUP BY anchor)"


@query("p2_tokens", f"WITH {TOKS} SELECT source_id, pos AS position, anchor, eligible AS count_eligible FROM toks")
def _(spark, sf):
    return relations.placed_anchors(docs(spark, sf)).select("source_id", F.col("position").cast("long").alias("position"), "anchor", "count_eligible")


@query("a1_token_counts", f"WITH {TOKS}, {COUNTS} SELECT * FROM cnt")
def _(spark, sf):
    return relations.token_counts(docs(spark, sf))


@query("j1_relations", f"""WITH {TOKS}, {PAIRS} SELECT source_id, "offset", count(*)::BIGINT AS relations, sum(observations)::BIGINT AS observations,
    {_hash('anchor', 'neighbor', 'observations')} AS digest FROM rel GROUP BY ALL""")
def _(spark, sf):
    rel = relations.relations(docs(spark, sf))
    return rel.groupBy("source_id", "offset").agg(F.count(F.lit(1)).alias("relations"), F.sum("observations").alias("observations"), F.sum(rows_hash(F.col("anchor"), F.col("neighbor"), F.col("observations"))).alias("digest"))


@query("j1_corpus_relations", f"""WITH {TOKS}, {PAIRS}, flat AS (SELECT anchor, "offset", neighbor, sum(observations)::BIGINT AS n FROM rel GROUP BY ALL)
    SELECT anchor, count(*)::BIGINT AS relations, sum(n)::BIGINT AS observations, {_hash('"offset"', 'neighbor', 'n')} AS digest FROM flat GROUP BY anchor""")
def _(spark, sf):
    rel = relations.corpus_relations(docs(spark, sf))
    return rel.groupBy("anchor").agg(F.count(F.lit(1)).alias("relations"), F.sum("observations").alias("observations"), F.sum(rows_hash(F.col("offset"), F.col("neighbor"), F.col("observations"))).alias("digest"))


_ASKED_SQL = ", ".join(f"'{a}'" for a in ASKED)


@query("t1_neighbors", f"""WITH {TOKS}, {PAIRS},
    g AS (SELECT anchor, "offset", neighbor, sum(observations)::BIGINT AS n FROM rel WHERE anchor IN ({_ASKED_SQL}) GROUP BY ALL),
    b AS (SELECT anchor, NULL::INT AS "offset", neighbor, sum(n)::BIGINT AS n FROM g GROUP BY ALL UNION ALL SELECT * FROM g)
    SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY anchor, "offset" ORDER BY n DESC, neighbor))::INT AS "rank" FROM b) WHERE "rank" <= 12""")
def t1_neighbors(spark, sf):
    return context.neighbors(relations.corpus_relations(docs(spark, sf), asked=ASKED), ASKED)


@query("a5_context_views", f"""WITH {TOKS}, {PAIRS}, f AS (SELECT anchor, "offset", neighbor, sum(observations)::BIGINT AS n FROM rel GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY anchor, "offset" ORDER BY n DESC, neighbor) AS k, sum(n) OVER (PARTITION BY anchor, "offset") AS total FROM f)
    SELECT CASE WHEN "offset" < 0 THEN 'before' ELSE 'after' END AS side, abs("offset")::INT AS distance, neighbor, count(*)::BIGINT AS anchors,
           sum(n)::BIGINT AS n, {_hash('anchor', 'n', 'total', 'k')} AS digest FROM r WHERE k <= 6 GROUP BY ALL""")
def _(spark, sf):
    views = context.context_views(relations.corpus_relations(docs(spark, sf)))
    return views.groupBy("side", "distance", "neighbor").agg(F.count(F.lit(1)).alias("anchors"), F.sum("n").alias("n"), F.sum(rows_hash(F.col("anchor"), F.col("n"), F.col("total"), F.col("rank"))).alias("digest"))


@query("a6_anchor_index", f"""WITH {TOKS}, {PAIRS}, {COUNTS}, a AS (SELECT anchor, sum(observations)::BIGINT AS around FROM rel GROUP BY anchor)
    SELECT anchor, n AS centre, coalesce(around, 0) AS around, n + coalesce(around, 0) AS total FROM cnt LEFT JOIN a USING (anchor)""")
def _(spark, sf):
    d = docs(spark, sf)
    return context.anchor_index(relations.token_counts(d), relations.corpus_relations(d))


_PAIRED = """
    o AS (SELECT source_id, anchor, neighbor, "offset", sum(observations)::BIGINT AS o FROM rel GROUP BY ALL),
    p AS (SELECT source_id, anchor, neighbor, sum(o)::BIGINT AS observations,
                 list(CASE WHEN "offset" > 0 THEN '+' ELSE '' END || "offset"::VARCHAR ORDER BY o DESC, CASE WHEN "offset" > 0 THEN '+' ELSE '' END || "offset"::VARCHAR) AS offs
          FROM o GROUP BY ALL),
    q AS (SELECT *, max(observations) OVER w AS top, sum(observations) OVER w AS total,
                 row_number() OVER (PARTITION BY source_id, anchor ORDER BY observations DESC, neighbor) AS k
          FROM p WINDOW w AS (PARTITION BY source_id, anchor))"""


@query("a9_profiles", f"""WITH {TOKS}, {PAIRS}, f AS (SELECT source_id, anchor, "offset", neighbor, sum(observations)::BIGINT AS n FROM rel GROUP BY ALL),
    r AS (SELECT *, max(n) OVER w AS top, row_number() OVER (PARTITION BY source_id, anchor, "offset" ORDER BY n DESC, neighbor) AS k FROM f WINDOW w AS (PARTITION BY source_id, anchor, "offset"))
    SELECT source_id, "offset", count(*)::BIGINT AS rows_n, {_hash('anchor', 'neighbor', 'n', 'round(n / top * 1e6)::BIGINT', 'k')} AS digest FROM r WHERE k <= 12 GROUP BY ALL""")
def _(spark, sf):
    rows = by_source.positional_profiles(docs(spark, sf))
    return rows.groupBy("source_id", "offset").agg(F.count(F.lit(1)).alias("rows_n"), F.sum(rows_hash(F.col("anchor"), F.col("neighbor"), F.col("observations"), F.round(F.col("score") * 1e6).cast("long"), F.col("rank"))).alias("digest"))


@query("a10_directional", f"""WITH {TOKS}, {PAIRS}, {_PAIRED}
    SELECT source_id, neighbor, count(*)::BIGINT AS anchors, {_hash('anchor', "array_to_string(offs, ',')", 'observations', 'round(observations / total * 1e6)::BIGINT')} AS digest FROM q WHERE k <= 12 GROUP BY ALL""")
def _(spark, sf):
    rows = by_source.directional_resonance(docs(spark, sf))
    return rows.groupBy("source_id", "neighbor").agg(F.count(F.lit(1)).alias("anchors"), F.sum(rows_hash(F.col("anchor"), F.col("offsets"), F.col("observations"), F.round(F.col("score") * 1e6).cast("long"))).alias("digest"))


@query("a11_clouds", f"""WITH {TOKS}, {PAIRS}, {_PAIRED}
    SELECT source_id, anchor, count(*)::BIGINT AS members, {_hash('neighbor', "array_to_string(offs[1:3], ',')", 'round(observations / top * 1e6)::BIGINT')} AS digest FROM q WHERE k <= 12 AND round(observations / top, 6) >= 0.3 GROUP BY ALL""")
def _(spark, sf):
    rows = by_source.context_clouds(docs(spark, sf))
    return rows.groupBy("source_id", "anchor").agg(F.count(F.lit(1)).alias("members"), F.sum(rows_hash(F.col("neighbor"), F.col("offsets"), F.round(F.col("strength") * 1e6).cast("long"))).alias("digest"))


@query("j5_overlay", f"""WITH {TOKS}, {PAIRS}, f AS (SELECT source_id, anchor, neighbor, sum(observations)::BIGINT AS n FROM rel GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id, anchor ORDER BY n DESC, neighbor) AS k FROM f)
    SELECT source_id, neighbor, count(*)::BIGINT AS anchors, sum(n)::BIGINT AS n, {_hash('anchor', 'n', 'k')} AS digest FROM r WHERE k <= 12 GROUP BY ALL""")
def _(spark, sf):
    rows = by_source.overlay(docs(spark, sf))
    return rows.groupBy("source_id", "neighbor").agg(F.count(F.lit(1)).alias("anchors"), F.sum("n").alias("n"), F.sum(rows_hash(F.col("anchor"), F.col("n"), F.col("rank"))).alias("digest"))


_CELLS = """cells AS (SELECT anchor AS root, "offset", neighbor, (regexp_extract(source, '(\\d+)$', 1)::INT % 5) AS lane, sum(observations)::BIGINT AS "count"
    FROM rel JOIN documents ON doc_id = source_id GROUP BY ALL)"""


@query("a2_merge", f"""WITH {TOKS}, {PAIRS}, {_CELLS} SELECT root, lane, count(*)::BIGINT AS relations, sum("count")::BIGINT AS n, {_hash('"offset"', 'neighbor', '"count"')} AS digest FROM cells GROUP BY ALL""")
def _(spark, sf):
    merged = counts.merge(cell_rows(spark, sf))
    return merged.groupBy("root", "lane").agg(F.count(F.lit(1)).alias("relations"), F.sum("count").alias("n"), F.sum(rows_hash(F.col("offset"), F.col("neighbor"), F.col("count"))).alias("digest"))


_QUESTION_SQL = ", ".join(f"'{a}'" for a in QUESTION)


@query("t16_score", f"""WITH {TOKS}, {PAIRS}, {_CELLS}
    SELECT neighbor, round(sum("count" / abs("offset")), 6) AS score, count(DISTINCT root)::BIGINT AS roots FROM cells
    WHERE root IN ({_QUESTION_SQL}) AND lane IN (0, 1, 2, 4) GROUP BY neighbor ORDER BY score DESC, roots DESC, neighbor LIMIT 12""")
def _(spark, sf):
    return counts.score(cell_rows(spark, sf, QUESTION), QUESTION, [0, 1, 2, 4])


@query("t18_attention", f"""WITH {TOKS}, {PAIRS}
    SELECT neighbor, count(DISTINCT anchor)::BIGINT AS support, round(sum(observations / abs("offset")) + count(DISTINCT anchor) * 8.0, 6) AS score FROM rel
    WHERE anchor IN ({_QUESTION_SQL}) AND neighbor NOT IN ('.', ',') GROUP BY neighbor ORDER BY score DESC, neighbor LIMIT 12""")
def _(spark, sf):
    return counts.attention(relations.corpus_relations(docs(spark, sf)), QUESTION, [".", ","])


@query("a7_union_counts", """SELECT source, sum(n)::BIGINT AS n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source
    UNION ALL SELECT source, sum(n_chars) FROM documents GROUP BY source) GROUP BY source""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    a, b = d.groupBy("source").agg(F.count(F.lit(1)).alias("n")), d.groupBy("source").agg(F.sum("n_chars").alias("n"))
    return counts.union_counts(a, b, keys=["source"], count="n")


_GLUE_SQL = ", ".join(f"'{g}'" for g in phrases.GLUE)
_FOLD = "replace(replace({0}, 'ß', 'ss'), 'ς', 'σ')"
_GRAMS = rf"""
    st AS (SELECT source_id, list(a ORDER BY pos) AS s FROM (SELECT source_id, pos, {_FOLD.format("anchor")} AS a FROM toks)
           WHERE NOT (starts_with(a, 'u') AND length(a) >= 8) AND regexp_matches(a, '[\p{{L}}\p{{N}}]') GROUP BY source_id),
    sp AS (SELECT source_id, s, n, unnest(range(1, (len(s) - n + 2)::BIGINT)) AS i FROM st CROSS JOIN (SELECT unnest(range(2, 6)) AS n)),
    gr AS (SELECT source_id, n::INT AS n, s[i:i + n - 1] AS g, CASE WHEN i > 1 THEN s[i - 1] ELSE '<START>' END AS l, coalesce(s[i + n], '<END>') AS r FROM sp),
    gk AS (SELECT source_id, n, array_to_string(g, ' ') AS phrase, g, l, r FROM gr WHERE len(list_filter(g, lambda x: x NOT IN ({_GLUE_SQL}))) > 0),
    tot AS (SELECT phrase, n, any_value(g) AS g, count(*)::BIGINT AS occurrences, count(DISTINCT source_id)::BIGINT AS sources FROM gk GROUP BY phrase, n HAVING count(*) >= 2),
    md AS (SELECT phrase, sum(c) AS modes FROM (SELECT phrase, side, max(c) AS c FROM (
               SELECT phrase, 'l' AS side, l AS w, count(*) AS c FROM gk GROUP BY phrase, l UNION ALL SELECT phrase, 'r', r, count(*) FROM gk GROUP BY phrase, r) GROUP BY phrase, side) GROUP BY phrase),
    cand AS (SELECT phrase, n, g, occurrences, sources, round(modes / occurrences, 6) AS stability FROM tot JOIN md USING (phrase))"""


@query("a13_ngrams", f"WITH {TOKS}, {_GRAMS} SELECT phrase, n, occurrences, sources, stability FROM cand")
def _(spark, sf):
    return phrases.mined(phrases.streams(docs(spark, sf)))


@query("a14_phrase_scores", f"""WITH {TOKS}, {_GRAMS},
    c AS (SELECT *, len(list_filter(g, lambda x: x IN ({_GLUE_SQL}))) AS glue, (g[1] IN ({_GLUE_SQL}))::INT + (g[-1] IN ({_GLUE_SQL}))::INT AS edges FROM cand)
    SELECT phrase, round(occurrences * 2.0 + sources * 3.0 + n * 1.5 + (n - glue) / n + stability + CASE WHEN glue = n THEN glue * -1.25 ELSE glue * -0.25 END
           + edges * -4.0 + CASE WHEN n - glue <= 1 THEN -3.0 ELSE 0.0 END, 6)::DOUBLE AS score,
           CASE WHEN glue = 0 THEN 'concept' WHEN edges > 0 THEN 'director_or_structure' ELSE 'concept_with_director' END AS kind FROM c""")
def _(spark, sf):
    return phrases.scored(phrases.mined(phrases.streams(docs(spark, sf)))).select("phrase", "score", "kind")


@query("j9_known_missing", f"""WITH {TOKS}, {COUNTS}, {KNOWN}
    SELECT CASE WHEN lex.anchor IS NULL THEN 'missing' ELSE 'known' END AS status, count(*)::BIGINT AS anchors, sum(n)::BIGINT AS observations FROM cnt LEFT JOIN lex USING (anchor) GROUP BY ALL""")
def _(spark, sf):
    return lexicon.known_and_missing(relations.token_counts(docs(spark, sf)), known(spark, sf))


@query("h2_symbols", f"WITH {KNOWN} SELECT anchor, '0x' || lpad(upper(to_hex(symbol)), 10, '0') AS symbol FROM lex")
def _(spark, sf):
    return known(spark, sf).select("anchor", S.symbol_hex(F.col("symbol")).alias("symbol"))


@query("j8_symbols", f"""WITH {TOKS}, {KNOWN}
    SELECT DISTINCT source_id, toks.anchor, CASE WHEN symbol IS NULL THEN '0xF' || upper(left(sha1(source_id::VARCHAR || chr(10) || toks.anchor), 9))
        ELSE '0x' || lpad(upper(to_hex(symbol)), 10, '0') END AS symbol, symbol IS NOT NULL AS known FROM toks LEFT JOIN lex ON lex.anchor = toks.anchor""")
def _(spark, sf):
    return lexicon.symbol_table(relations.placed_anchors(docs(spark, sf)), known(spark, sf))


@query("j14_fates", f"""WITH {TOKS}, {PAIRS}, {KNOWN}
    SELECT CASE WHEN a.anchor IS NULL THEN 'local' ELSE 'canonical' END || '-' || CASE WHEN b.anchor IS NULL THEN 'local' ELSE 'canonical' END AS fate,
           count(*)::BIGINT AS relations, sum(observations)::BIGINT AS observations FROM rel LEFT JOIN lex a ON a.anchor = rel.anchor LEFT JOIN lex b ON b.anchor = rel.neighbor GROUP BY ALL""")
def _(spark, sf):
    return lexicon.relation_fates(relations.relations(docs(spark, sf)), known(spark, sf))


@query("j11_fuzzy", f"""WITH {TOKS}, {KNOWN}, m AS (SELECT DISTINCT anchor FROM toks ANTI JOIN lex USING (anchor) WHERE regexp_matches(anchor, '\\p{{L}}')),
    l AS (SELECT anchor, regexp_extract(anchor, '\\p{{L}}') AS fl, unnest(range(greatest(1, length(anchor) - 1), length(anchor) + 2)) AS len FROM m),
    r AS (SELECT anchor AS other, regexp_extract(anchor, '\\p{{L}}') AS fl0, CASE WHEN fl0 = '' THEN 'a' ELSE fl0 END AS fl, length(anchor) AS len FROM lex),
    n AS (SELECT l.anchor, other, abs(length(l.anchor) - length(other)) AS gap FROM l JOIN r ON upper(l.fl) = upper(r.fl) AND l.len = r.len
          WHERE CASE WHEN length(l.anchor) = length(other) THEN len(list_filter(range(1, length(other) + 1), lambda i: l.anchor[i] <> other[i])) = 1
                     WHEN length(l.anchor) > length(other) THEN len(list_filter(range(1, length(l.anchor) + 1), lambda i: substr(l.anchor, 1, i - 1) || substr(l.anchor, i + 1) = other)) > 0
                     ELSE len(list_filter(range(1, length(other) + 1), lambda i: substr(other, 1, i - 1) || substr(other, i + 1) = l.anchor)) > 0 END),
    k AS (SELECT *, rank() OVER (PARTITION BY anchor ORDER BY gap) AS k FROM n)
    SELECT anchor, min(other) AS suggestion FROM k WHERE k = 1 GROUP BY anchor HAVING count(*) = 1""")
def _(spark, sf):
    lex = known(spark, sf)
    missing = relations.token_counts(docs(spark, sf)).join(lex, "anchor", "left_anti")
    return lexicon.suggestions(missing, lex)


_L = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_LANES = rf"""lanes AS (SELECT anchor, n, CASE WHEN s = '' OR contains(s, '<') OR contains(s, '>') OR contains(s, '="') OR contains(s, 'm:') THEN 'null_symbol_anchors'
    WHEN regexp_matches(low, '(?:^|[_-])(?:ch\d+|mod\d+|fig(?:ure)?|table|review_questions|self_check_questions|critical_thinking_questions|problem|solution)(?:$|[_-])') OR regexp_matches(low, '^(?:[a-z]+)?\d+[a-z]*(?:[_-][a-z0-9]+)+$') THEN 'source_id_artifacts'
    WHEN low IN ({_L(lexicon.CLEANUP)}) OR low IN ({_L(lexicon.ABBREVIATIONS)}) THEN 'source_cleanup_candidates' WHEN low IN ({_L(lexicon.NOTATION)}) THEN 'domain_notation_anchors' WHEN low IN ({_L(lexicon.MATH_MARKUP)}) THEN 'math_markup'
    WHEN s IN ({_L(lexicon.MATH_SYMBOLS)}) OR low IN ({_L(lexicon.MATH_TERMS)}) THEN 'math_terms_or_symbols' WHEN low IN ({_L(lexicon.STRUCTURE)}) THEN 'structural_source_anchors'
    WHEN left(s, 1) IN ({_L(lexicon.MOJIBAKE)}) THEN 'null_symbol_anchors' WHEN length(s) >= 3 AND regexp_matches(s, '^\p{{L}}(?:[\p{{L}}''’‘]*\p{{L}})$') THEN 'unknown_real_word_candidates'
    WHEN NOT regexp_matches(s, '^[A-Za-z0-9_\-]+$') THEN 'null_symbol_anchors' WHEN regexp_matches(low, '^[a-z][a-z''-]{{2,}}$') THEN 'unknown_real_word_candidates' ELSE 'null_symbol_anchors' END AS lane
    FROM (SELECT cnt.anchor, n, trim(cnt.anchor) AS s, {_FOLD.format("lower(trim(cnt.anchor))")} AS low FROM cnt ANTI JOIN lex ON lex.anchor = cnt.anchor))"""


@query("f1_lanes", f"WITH {TOKS}, {COUNTS}, {KNOWN}, {_LANES} SELECT anchor, n, lane FROM lanes")
def _(spark, sf):
    missing = relations.token_counts(docs(spark, sf)).join(known(spark, sf), "anchor", "left_anti")
    return missing.select("anchor", "n", lexicon.lane(F.col("anchor")).alias("lane"))


@query("a17_lane_rollup", f"""WITH {TOKS}, {COUNTS}, {KNOWN}, {_LANES} SELECT l.lane, count(lanes.anchor)::BIGINT AS anchors, coalesce(sum(n), 0)::BIGINT AS observations FROM (SELECT unnest([{_L(lexicon.LANES)}]) AS lane) l LEFT JOIN lanes ON lanes.lane = l.lane GROUP BY l.lane""")
def _(spark, sf):
    return lexicon.lane_rollup(relations.token_counts(docs(spark, sf)).join(known(spark, sf), "anchor", "left_anti"))


@query("a18_letters", """WITH w AS (SELECT DISTINCT c_name AS word FROM customer UNION SELECT DISTINCT p_name FROM part),
    own AS (SELECT CASE WHEN regexp_extract(lower(word), '\\p{L}') = '' THEN 'A' ELSE upper(regexp_extract(lower(word), '\\p{L}')) END AS letter, count(*)::BIGINT AS n FROM w GROUP BY ALL)
    SELECT coalesce(l.letter, own.letter) AS letter, coalesce(n, 0) AS n FROM (SELECT chr((65 + i)::INT) AS letter FROM range(26) t(i)) l FULL JOIN own ON own.letter = l.letter""")
def _(spark, sf):
    words = table(spark, sf, "customer").select(F.col("c_name").alias("word")).union(table(spark, sf, "part").select("p_name")).distinct()
    return lexicon.letter_distribution(words)


@query("a22_dedupe", "SELECT word, doc_id FROM (SELECT source AS word, doc_id, row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def _(spark, sf):
    return lexicon.dedupe(docs(spark, sf).select(F.col("source").alias("word"), "doc_id"), ["doc_id"])


@query("d1_assign", """WITH w AS (SELECT DISTINCT n_name AS word FROM nation), s AS (SELECT DISTINCT r_regionkey + 100 * k AS slot FROM region, range(20) t(k))
    SELECT word, slot FROM (SELECT word, row_number() OVER (ORDER BY word) AS i FROM w) JOIN (SELECT slot, row_number() OVER (ORDER BY slot) AS i FROM s) USING (i)""")
def _(spark, sf):
    words = table(spark, sf, "nation").select(F.col("n_name").alias("word"))
    slots = table(spark, sf, "region").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.col("r_regionkey") + k * 100)).alias("slot"))
    return lexicon.assign(words, slots, words.limit(0))


@query("a19_registry", f"""WITH {TOKS} SELECT anchor, count(*)::BIGINT AS observations, min(source_id) AS first_seen, max(source_id) AS last_seen FROM toks GROUP BY anchor""")
def _(spark, sf):
    rows = relations.placed_anchors(docs(spark, sf)).select("anchor", F.lit(1).cast("long").alias("observations"), F.col("source_id").alias("first_seen"), F.col("source_id").alias("last_seen"))
    return lexicon.registry_upsert(rows.where("first_seen % 2 = 0"), rows.where("first_seen % 2 <> 0"))


@query("j17_review_queue", f"""WITH {TOKS}, {COUNTS}, {KNOWN} SELECT cnt.anchor, n AS observations, CASE WHEN n % 5 = 0 THEN 'pending' ELSE 'unmatched' END AS status
    FROM cnt ANTI JOIN lex ON lex.anchor = cnt.anchor WHERE n >= 2 AND n % 7 <> 0""")
def _(spark, sf):
    c = relations.token_counts(docs(spark, sf)).withColumnRenamed("n", "observations")
    return lexicon.review_queue(c, known(spark, sf), c.where("observations % 7 = 0"), c.where("observations % 5 = 0"), 2)


@query("t4_search", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%12%' ORDER BY c_custkey LIMIT 50")
def _(spark, sf):
    return lexicon.search(table(spark, sf, "customer").select("c_custkey", "c_name"), "12", ["c_name"], ["c_custkey"])


@query("t7_top", f"WITH {TOKS}, {COUNTS} SELECT anchor, n FROM cnt ORDER BY n DESC, anchor LIMIT 50")
def _(spark, sf):
    return relations.token_counts(docs(spark, sf)).orderBy(F.desc("n"), "anchor").limit(50)


@query("t9_page", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20)


@query("t6_sample", "SELECT doc_id, source FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 20")
def _(spark, sf):
    """Twenty rows chosen by the least hash, the same for every layout; each task keeps twenty."""
    return docs(spark, sf).select("doc_id", "source").orderBy(F.md5(F.concat_ws("|", F.lit("7"), "doc_id").cast("binary")), "doc_id").limit(20)


_TERMS = r"""list_distinct_ordered(regexp_extract_all({0}, '[a-z0-9]+(?:''[a-z0-9]+)?'))"""


@query("t14_terms", r"""SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_distinct(list_transform(list_transform(regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[a-z0-9]+(?:''[a-z0-9]+)?'),
    lambda t: CASE WHEN length(t) > 3 AND ends_with(t, 's') THEN left(t, length(t) - 1) ELSE t END), lambda t: t))), lambda t: t), ' ') AS terms FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(X.search_terms(F.col("text"))), " ").alias("terms"))


@query("t13_chat_search", r"""WITH h AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[a-z0-9]+(?:''[a-z0-9]+)?'),
    lambda t: CASE WHEN length(t) > 3 AND ends_with(t, 's') THEN left(t, length(t) - 1) ELSE t END)) AS h FROM conversations)
    SELECT conv_id, turn, (200 + 2 - least(25, greatest(0, len(h) - 2) // 12))::BIGINT AS score, 'the of' AS hit_terms FROM h WHERE list_contains(h, 'the') AND list_contains(h, 'of')
    ORDER BY score DESC, conv_id, turn LIMIT 50""")
def _(spark, sf):
    return search.chat_search(table(spark, sf, "conversations"), "The of").select("conv_id", "turn", "score", "hit_terms")


@query("t15_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def _(spark, sf):
    return search.history(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role")


@query("s17_turns", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST))::INT AS turn_no FROM conversations")
def _(spark, sf):
    return search.conversation_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "turn_no")


@query("t11_evidence", f"""WITH b AS (SELECT doc_id AS d, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
    bb AS (SELECT d * 100000 + k AS bid, text FROM b), {_tokens("bb", "bid", "t")},
    s AS (SELECT source_id AS bid, list_distinct(list(anchor)) AS a FROM t GROUP BY ALL),
    h AS (SELECT bid, len(a) AS n, list_sort(list_filter(a, lambda x: x IN ({_QUESTION_SQL}))) AS h FROM s),
    sc AS (SELECT bid // 100000 AS source_id, bid % 100000 AS block_id, array_to_string(h, ' ') AS hits, round(len(h) * 100 + len(h) / n, 6) AS score FROM h WHERE len(h) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, block_id) AS k FROM sc)
    SELECT source_id, block_id::INT AS block_id, hits, score FROM r WHERE k <= 8 ORDER BY score DESC, source_id, block_id LIMIT 12""")
def _(spark, sf):
    blocks = docs(spark, sf).select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("block_id", "text"))
    return search.evidence(blocks, QUESTION, proximity=False)


@query("a25_content_dedupe", r"""WITH h AS (SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS hash FROM documents)
    SELECT doc_id, hash, CASE WHEN min(doc_id) OVER (PARTITION BY hash) <> doc_id THEN min(doc_id) OVER (PARTITION BY hash) END AS duplicate_of FROM h""")
def _(spark, sf):
    return dedupe.content_duplicates(table(spark, sf, "documents"))


_CELL_SQL = """c AS (SELECT label::VARCHAR AS stream_id, vec_id AS frame_number, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    f AS (SELECT stream_id, frame_number, row_number() OVER (PARTITION BY stream_id ORDER BY frame_number) AS k FROM (SELECT DISTINCT stream_id, frame_number FROM c)),
    dl AS (SELECT c.stream_id, c.frame_number, c.i, c.x, abs(c.x - coalesce(p.x, c.x)) AS d FROM c JOIN f ON f.stream_id = c.stream_id AND f.frame_number = c.frame_number
           LEFT JOIN f g ON g.stream_id = f.stream_id AND g.k = f.k - 1 LEFT JOIN c p ON p.stream_id = c.stream_id AND p.frame_number = g.frame_number AND p.i = c.i)"""


@query("w8_delta", f"WITH {_CELL_SQL} SELECT stream_id, frame_number, round(sum(d), 6) AS total, round(max(d), 6) AS peak FROM dl GROUP BY ALL")
def _(spark, sf):
    d = frames.deltas(grids(spark, sf))
    return d.select("stream_id", "frame_number", F.round(F.aggregate("delta", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("delta"), 6).alias("peak"))


@query("w2_energy", f"""WITH {_CELL_SQL}, ru AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY stream_id, frame_number ORDER BY d DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(d) OVER (PARTITION BY stream_id, frame_number) AS t FROM dl)
    SELECT stream_id, frame_number, round(sum(d), 6) AS energy_total, round(avg(d), 6) AS energy_mean, round(stddev_pop(d), 6) AS energy_std, round(avg((d < 0.01)::INT), 6) AS static_ratio,
    round(CASE WHEN sum(d) > 1e-8 THEN count_if(before < 0.5 * t) / count(*) ELSE 0 END, 6) AS motion_concentration_50 FROM ru GROUP BY ALL""")
def _(spark, sf):
    e = frames.energy(grids(spark, sf))
    return e.select("stream_id", "frame_number", *(F.round(c, 6).alias(c) for c in ("energy_total", "energy_mean", "energy_std", "static_ratio", "motion_concentration_50")))


@query("w9_blocks", f"WITH {_CELL_SQL} SELECT stream_id, frame_number, (i // 8) // 2 AS br, (i % 8) // 2 AS bc, round(avg(x), 6) AS mean FROM c GROUP BY ALL")
def _(spark, sf):
    return frames.blocks(grids(spark, sf), 8, 2).withColumn("mean", F.round("mean", 6))


@query("w14_accuracy", f"WITH {_CELL_SQL} SELECT stream_id, frame_number, round(avg(abs(x - round(x, 1))), 6) AS mae, round(max(abs(x - round(x, 1))), 6) AS max_error, round(sqrt(avg((x - round(x, 1)) ** 2)), 6) AS rmse FROM c GROUP BY ALL")
def _(spark, sf):
    g = grids(spark, sf)
    e = frames.replay_error(g, g.withColumn("cells", F.transform("cells", lambda x: F.round(x, 1))))
    return e.select("stream_id", "frame_number", *(F.round(c, 6).alias(c) for c in ("mae", "max_error", "rmse")))


@query("w1_ema", """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    e AS (SELECT user_id, event_id, k, value::DOUBLE AS ema FROM o WHERE k = 1
          UNION ALL SELECT o.user_id, o.event_id, o.k, 0.3 * o.value + 0.7 * e.ema FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1)
    SELECT event_id, user_id, round(ema, 4) AS ema FROM e""")
def _(spark, sf):
    return frames.ema(table(spark, sf, "events"), 0.3, "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", F.round("ema", 4).alias("ema"))


@query("w12_chunks", "SELECT label::VARCHAR AS stream_id, vec_id AS frame_number, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS chunk_id FROM embeddings")
def _(spark, sf):
    return frames.chunks(grids(spark, sf), 16).select("stream_id", "frame_number", "chunk_id")


@query("a30_summary", """SELECT feature, min(x) AS low, max(x) AS high, round(avg(x), 6) AS mean, count(x)::BIGINT AS n FROM (
    SELECT 'l_quantity' AS feature, l_quantity::DOUBLE AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount::DOUBLE FROM lineitem) GROUP BY feature""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_discount").cast("double").alias("l_discount"))
    return frames.summary(rows, ["l_quantity", "l_discount"]).withColumn("mean", F.round("mean", 6))


@query("g1_graph", f"""WITH {TOKS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)
    SELECT 'node' AS part, 'document' AS type, (SELECT count(*) FROM documents)::BIGINT AS n UNION ALL SELECT 'node', 'line', (SELECT count(*) FROM l)
    UNION ALL SELECT 'node', 'symbol', (SELECT count(DISTINCT anchor) FROM toks) UNION ALL SELECT 'node', 'occurrence', (SELECT count(*) FROM toks)
    UNION ALL SELECT 'edge', 'document-line', (SELECT count(*) FROM l) UNION ALL SELECT 'edge', 'line-occurrence', (SELECT count(*) FROM toks) UNION ALL SELECT 'edge', 'occurrence-symbol', (SELECT count(*) FROM toks)""")
def _(spark, sf):
    return graph.contract(*graph.document_graph(docs(spark, sf)))
