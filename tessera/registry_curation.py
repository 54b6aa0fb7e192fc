"""Queries of the lexicon's curation. The lexicon is the tokens of ``benchmark``; the queue holds the tokens of
``documents`` it lacks, by frequency pending or unmatched and ignored where they are one character; slots are order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import symbols as S
from tessera.functions import text as X
from tessera.operators import context, curation, lexicon, phrases, relations
from tessera.registry import _GLUE_SQL, ASKED, COUNTS, KNOWN, PAIRS, QUESTION, TOKS, _hash, _tokens, docs, known, query, rows_hash, table
from tessera.registry_questions import _TALK, talk

_ASKED = ", ".join(f"'{a}'" for a in ASKED)
_ASK = ", ".join(f"'{a}'" for a in QUESTION)
_QUEUE = """queue AS (SELECT cnt.anchor AS word, n AS frequency, CASE WHEN length(cnt.anchor) = 1 THEN 'ignored' WHEN n >= 5 THEN 'pending' ELSE 'unmatched' END AS status
    FROM cnt ANTI JOIN lex ON lex.anchor = cnt.anchor)"""
_SLOTS = "slots AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS slot, CASE WHEN l_returnflag = 'N' THEN 'Available' ELSE 'USED' END AS status FROM lineitem)"
_ASSIGN = """w AS (SELECT word, row_number() OVER (ORDER BY word) AS i FROM ({0})), f AS (SELECT slot, row_number() OVER (ORDER BY slot) AS i FROM slots WHERE upper(status) = 'AVAILABLE'),
    given AS (SELECT word, slot FROM w JOIN f USING (i) WHERE (SELECT count(*) FROM w) <= (SELECT count(*) FROM f))"""


def missing(spark, sf):
    return relations.token_counts(docs(spark, sf)).join(known(spark, sf), "anchor", "left_anti")


def queue(spark, sf):
    w = F.col("anchor")
    state = F.when(F.char_length(w) == 1, "ignored").when(F.col("n") >= 5, "pending").otherwise("unmatched")
    return missing(spark, sf).select(w.alias("word"), F.col("n").alias("frequency"), state.alias("status"))


def slots(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("slot"), F.when(F.col("l_returnflag") == "N", "Available").otherwise("USED").alias("status"))
    return rows.distinct()


@query("j10_recognition", f"""WITH {_TALK}, {KNOWN}, e AS (SELECT conv_id, turn, unnest(a) AS x, generate_subscripts(a, 1) AS p FROM tk), k AS (SELECT e.*, lex.anchor IS NOT NULL AS k FROM e LEFT JOIN lex ON lex.anchor = x)
    SELECT c.conv_id, c.turn, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE k), '') AS represented, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT k), '') AS missing FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn GROUP BY ALL""")
def _(spark, sf):
    rows = curation.recognised(talk(spark, sf).select(F.struct("conv_id", "turn").alias("query_id"), "anchors"), known(spark, sf))
    return rows.select("query_id.*", F.array_join("represented", " ").alias("represented"), F.array_join("missing", " ").alias("missing"))


@query("j16_canonical", f"""WITH {TOKS}, {PAIRS}, {KNOWN}, f AS (SELECT anchor, "offset", neighbor, sum(observations)::BIGINT AS n FROM rel WHERE anchor IN (SELECT anchor FROM lex) AND neighbor IN (SELECT anchor FROM lex) GROUP BY ALL)
    SELECT anchor, count(*)::BIGINT AS relations, sum(n)::BIGINT AS observations, {_hash('"offset"', 'neighbor', 'n')} AS digest FROM f GROUP BY anchor""")
def _(spark, sf):
    rel = curation.canonical_relations(relations.corpus_relations(docs(spark, sf)), known(spark, sf))
    return rel.groupBy("anchor").agg(F.count(F.lit(1)).alias("relations"), F.sum("observations").alias("observations"), F.sum(rows_hash(F.col("offset"), F.col("neighbor"), F.col("observations"))).alias("digest"))


@query("j18_block_counts", f"""WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), l AS (SELECT doc_id * 1000000 + line AS lid, text FROM ln),
    {{0}}, c AS (SELECT source_id AS lid, count(*)::BIGINT AS n FROM lt GROUP BY ALL) SELECT lid // 1000000 AS doc_id, (lid % 1000000)::INT AS line, coalesce(n, 0)::BIGINT AS occurrences FROM l LEFT JOIN c USING (lid)""".replace("{0}", _tokens("l", "lid", "lt")))
def _(spark, sf):
    blocks = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    own = blocks.select("doc_id", "line", X.surfaces(F.col("text")).alias("s")).select("doc_id", "line", F.explode(X.anchors(F.col("s"))).alias("anchor"))
    return curation.block_counts(own, blocks.select("doc_id", "line"), ["doc_id", "line"])


_PH = "ph AS (SELECT DISTINCT p_name AS phrase_id, string_split(lower(p_name), ' ') AS s FROM part)"


@query("j22_memberships", f"WITH {_PH} SELECT w AS anchor, phrase_id, (list_position(s, w) - 1)::BIGINT AS at FROM (SELECT phrase_id, s, unnest(list_distinct(s)) AS w FROM ph)")
def _(spark, sf):
    own = table(spark, sf, "part").select(F.col("p_name").alias("phrase_id"), F.split(F.lower("p_name"), " ").alias("sequence")).distinct()
    asked = [r[0] for r in own.select(F.explode("sequence")).distinct().collect()]  # the few words of part names
    return curation.phrase_memberships(own, asked)


@query("t3_context_map", f"""WITH {TOKS}, {PAIRS}, f AS (SELECT anchor, "offset", neighbor, sum(observations)::BIGINT AS n FROM rel WHERE anchor IN ({_ASKED}) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY anchor, "offset" ORDER BY n DESC, neighbor) AS k, (sum(n) OVER (PARTITION BY anchor, "offset"))::BIGINT AS total FROM f)
    SELECT anchor, CASE WHEN "offset" < 0 THEN 'before' ELSE 'after' END AS side, abs("offset")::INT AS distance, neighbor, n, k::INT AS "rank", total FROM r WHERE k <= 6""")
def _(spark, sf):
    return context.context_views(relations.corpus_relations(docs(spark, sf)).where(F.col("anchor").isin(ASKED)))


@query("t5_browse", "WITH w AS (SELECT DISTINCT p_name AS word FROM part WHERE upper(regexp_extract(lower(p_name), '\\p{L}')) = 'B') SELECT word, (SELECT count(*) FROM w)::BIGINT AS total FROM w ORDER BY word LIMIT 50")
def _(spark, sf):
    return curation.browse(table(spark, sf, "part").select(F.col("p_name").alias("word")).distinct(), "b")


@query("t8_recent", "SELECT o_orderkey AS word, o_orderdate AS mapped_at FROM orders WHERE o_orderdate IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def _(spark, sf):
    return curation.recent(table(spark, sf, "orders").select(F.col("o_orderkey").alias("word"), F.col("o_orderdate").alias("mapped_at")))


@query("t17_score", f"""WITH {TOKS}, {PAIRS}, c AS (SELECT anchor AS root, "offset", neighbor, (regexp_extract(source, '(\\d+)$', 1)::INT % 5) AS lane, sum(observations)::BIGINT AS n FROM rel JOIN documents ON doc_id = source_id GROUP BY ALL)
    SELECT neighbor, round(sum(n / abs("offset")), 6) AS score, count(DISTINCT root)::BIGINT AS roots FROM c WHERE root IN ({_ASKED}) GROUP BY neighbor ORDER BY score DESC, roots DESC, neighbor LIMIT 12""")
def _(spark, sf):
    from tessera.operators import counts
    from tessera.registry import cell_rows

    return counts.score(cell_rows(spark, sf, ASKED), ASKED)


@query("t19_overlay_cloud", f"""WITH {TOKS}, {PAIRS}, g AS (SELECT source_id, neighbor, sum(observations)::BIGINT AS n, array_to_string(list_sort(list_distinct(list(anchor))), ' ') AS support FROM rel WHERE anchor IN ({_ASK}) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, neighbor) AS k FROM g) SELECT source_id, neighbor, n, support, k::INT AS "rank" FROM r WHERE k <= 6""")
def _(spark, sf):
    rows = curation.overlay_cloud(relations.relations(docs(spark, sf), asked=QUESTION), QUESTION)
    return rows.withColumn("support", F.array_join("support", " "))


@query("z44_find", f"""WITH {KNOWN}, w AS (SELECT DISTINCT anchor AS word FROM bench UNION SELECT 'no such word'), s AS (SELECT anchor AS word, symbol FROM lex WHERE regexp_matches(anchor, '^[^\\p{{L}}]'))
    SELECT word, CASE WHEN s.symbol IS NULL THEN 'canonical' ELSE 'structural' END AS pack, coalesce(s.symbol, lex.symbol)::BIGINT AS symbol FROM w LEFT JOIN s USING (word) JOIN lex ON lex.anchor = word""")
def _(spark, sf):
    lex = known(spark, sf).withColumnRenamed("anchor", "word")
    asked = lex.select("word").unionByName(spark.createDataFrame([("no such word",)], "word string"))
    return curation.found(asked, lex.where(F.col("word").rlike(r"^[^\p{L}]")), lex)


@query("z39_known", f"""WITH {KNOWN} SELECT DISTINCT anchor FROM lex UNION SELECT DISTINCT lower(n_name) FROM nation""")
def _(spark, sf):
    return known(spark, sf).select("anchor").unionByName(table(spark, sf, "nation").select(F.lower("n_name").alias("anchor"))).distinct()


@query("z40_last_symbols", "SELECT source AS word, max_by(n_chars, doc_id) AS symbol FROM documents GROUP BY source")
def _(spark, sf):
    return curation.last_symbols(table(spark, sf, "documents").select(F.col("source").alias("word"), F.col("n_chars").alias("symbol"), F.col("doc_id").alias("seq")))


@query("z51_unmatched", f"WITH {TOKS}, {COUNTS}, {KNOWN}, {_QUEUE} SELECT word, frequency FROM queue WHERE status = 'unmatched' AND starts_with(word, 't') ORDER BY frequency DESC, word LIMIT 100")
def _(spark, sf):
    return curation.listed(queue(spark, sf), "unmatched", "T").select("word", "frequency")


@query("z53_slots", f"WITH {_SLOTS} SELECT count_if(upper(status) = 'AVAILABLE')::BIGINT AS available, count(*)::BIGINT AS slots FROM slots")
def _(spark, sf):
    return slots(spark, sf).agg(F.count_if(F.upper("status") == "AVAILABLE").alias("available"), F.count(F.lit(1)).alias("slots"))


_WORDS = "asked AS (SELECT DISTINCT lower(unnest(regexp_extract_all(p_name, '\\S+'))) AS word FROM part UNION SELECT anchor FROM cnt WHERE length(anchor) = 2)"


def asked_words(spark, sf):
    parts = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return parts.unionByName(relations.token_counts(docs(spark, sf)).where(F.char_length("anchor") == 2).select(F.col("anchor").alias("word"))).distinct()


@query("d4_approve", f"""WITH {TOKS}, {COUNTS}, {KNOWN}, {_QUEUE}, {_WORDS}, a AS (SELECT word FROM asked ANTI JOIN lex ON lex.anchor = word)
    SELECT coalesce(queue.word, a.word) AS word, coalesce(frequency, 0)::BIGINT AS frequency, CASE WHEN a.word IS NOT NULL THEN 'pending' ELSE status END AS status FROM queue FULL JOIN a ON a.word = queue.word""")
def _(spark, sf):
    return curation.moved(queue(spark, sf), asked_words(spark, sf), "pending", known(spark, sf))


@query("d5_ignore", f"""WITH {TOKS}, {COUNTS}, {KNOWN}, {_QUEUE}, {_WORDS}
    SELECT coalesce(queue.word, asked.word) AS word, coalesce(frequency, 0)::BIGINT AS frequency, CASE WHEN asked.word IS NOT NULL THEN 'ignored' ELSE status END AS status FROM queue FULL JOIN asked ON asked.word = queue.word""")
def _(spark, sf):
    return curation.moved(queue(spark, sf), asked_words(spark, sf), "ignored")


@query("d5_unignore", f"WITH {TOKS}, {COUNTS}, {KNOWN}, {_QUEUE} SELECT word, frequency, status FROM queue WHERE NOT (status = 'ignored' AND word IN ('a', 'i', '-', 'é'))")
def _(spark, sf):
    return curation.unignored(queue(spark, sf), spark.createDataFrame([("a",), ("i",), ("-",), ("é",)], "word string"))


@query("d6_assign_pending", f"WITH {TOKS}, {COUNTS}, {KNOWN}, {_QUEUE}, {_SLOTS}, {_ASSIGN.format('SELECT word FROM queue WHERE status = ' + chr(39) + 'pending' + chr(39))} SELECT word, slot FROM given")
def _(spark, sf):
    return curation.assigned_pending(queue(spark, sf), slots(spark, sf), known(spark, sf).select(F.col("anchor").alias("word")))


@query("d7_approve_all", f"WITH {TOKS}, {COUNTS}, {KNOWN}, {_QUEUE} SELECT word, frequency, CASE WHEN status = 'unmatched' THEN 'pending' ELSE status END AS status FROM queue")
def _(spark, sf):
    return curation.moved_all(queue(spark, sf), "unmatched", "pending")


@query("d7_deny_all", f"WITH {TOKS}, {COUNTS}, {KNOWN}, {_QUEUE} SELECT word, frequency, CASE WHEN status = 'unmatched' THEN 'ignored' ELSE status END AS status FROM queue")
def _(spark, sf):
    return curation.moved_all(queue(spark, sf), "unmatched", "ignored")


@query("d8_clear", f"""WITH {_SLOTS}, e AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS slot FROM lineitem WHERE l_linestatus = 'F')
    SELECT slot, 'AVAILABLE' AS status FROM e UNION ALL SELECT slot, status FROM slots WHERE slot NOT IN (SELECT slot FROM e)""")
def _(spark, sf):
    entries = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("slot")).distinct()
    return curation.reclaimed(slots(spark, sf), entries)


@query("d9_import", f"""WITH {KNOWN}, {_SLOTS}, files AS (SELECT upper(left(lang, 1)) AS letter, doc_id AS at, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS word FROM documents),
    first AS (SELECT word, min(letter) AS letter FROM files GROUP BY word), n AS (SELECT word, letter FROM first ANTI JOIN lex ON lex.anchor = word), ok AS (SELECT (SELECT count(*) FROM n) <= (SELECT count(*) FROM slots WHERE upper(status) = 'AVAILABLE') AS ok)
    SELECT letter, count_if(lex.anchor IS NULL AND (SELECT ok FROM ok))::BIGINT AS bound, count_if(lex.anchor IS NOT NULL)::BIGINT AS skipped, count_if(lex.anchor IS NULL AND NOT (SELECT ok FROM ok))::BIGINT AS no_slots FROM first LEFT JOIN lex ON lex.anchor = word GROUP BY letter""")
def _(spark, sf):
    words = table(spark, sf, "documents").select(F.upper(F.substring("lang", 1, 1)).alias("letter"), F.col("doc_id").alias("at"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))).alias("w"))
    return curation.imported(words.select("letter", "at", F.lower("w").alias("word")), slots(spark, sf), known(spark, sf))


_ONE_EDIT = """CASE WHEN length(l.anchor) = length(other) THEN len(list_filter(range(1, length(other) + 1), lambda i: l.anchor[i] <> other[i])) = 1
    WHEN length(l.anchor) > length(other) THEN len(list_filter(range(1, length(l.anchor) + 1), lambda i: substr(l.anchor, 1, i - 1) || substr(l.anchor, i + 1) = other)) > 0
    ELSE len(list_filter(range(1, length(other) + 1), lambda i: substr(other, 1, i - 1) || substr(other, i + 1) = l.anchor)) > 0 END"""
#: A word and all that is left of it without one character: words within an edit share one of these.
_SHORTER = "list_distinct(list_concat([anchor], list_transform(range(1, length(anchor) + 1), lambda i: substr(anchor, 1, i - 1) || substr(anchor, i + 1))))"
_SUGGEST = f"""m AS (SELECT cnt.anchor, n FROM cnt ANTI JOIN lex ON lex.anchor = cnt.anchor), t AS (SELECT anchor FROM m WHERE length(anchor) >= 3 AND regexp_matches(anchor, '^\\p{{L}}[\\p{{L}}''’\\-]*\\p{{L}}$') AND NOT (upper(anchor) = anchor AND lower(anchor) <> anchor)),
    l AS (SELECT anchor, unnest({_SHORTER}) AS v FROM t), r AS (SELECT anchor AS other, unnest({_SHORTER}) AS v FROM lex), lr AS (SELECT DISTINCT anchor, other FROM l JOIN r USING (v)),
    p AS (SELECT *, upper(regexp_extract(anchor, '\\p{{L}}')) AS fl, upper(CASE WHEN regexp_extract(other, '\\p{{L}}') = '' THEN 'a' ELSE regexp_extract(other, '\\p{{L}}') END) AS fr FROM lr),
    nr AS (SELECT l.anchor, other, abs(length(l.anchor) - length(other)) AS gap FROM p l WHERE fl = fr AND abs(length(l.anchor) - length(other)) <= 1 AND {_ONE_EDIT}),
    kk AS (SELECT *, rank() OVER (PARTITION BY anchor ORDER BY gap) AS k FROM nr), sg AS (SELECT anchor, min(other) AS suggestion FROM kk WHERE k = 1 GROUP BY anchor HAVING count(*) = 1)"""


@query("z43_misspelled", f"WITH {TOKS}, {COUNTS}, {KNOWN}, {_SUGGEST} SELECT m.anchor, n AS observations, suggestion, CASE WHEN suggestion IS NULL THEN 'missing_anchor' ELSE 'possible_misspelling' END AS review_kind FROM m LEFT JOIN sg ON sg.anchor = m.anchor")
def _(spark, sf):
    return curation.misspelled(missing(spark, sf).withColumnRenamed("n", "observations"), known(spark, sf))


@query("z42_may_suggest", f"WITH {TOKS}, {COUNTS} SELECT anchor, length(anchor) >= 3 AND regexp_matches(anchor, '^\\p{{L}}[\\p{{L}}''’\\-]*\\p{{L}}$') AND NOT (upper(anchor) = anchor AND lower(anchor) <> anchor) AS tried FROM cnt")
def _(spark, sf):
    return relations.token_counts(docs(spark, sf)).select("anchor", curation.may_suggest(F.col("anchor")).alias("tried"))


@query("d12_resolve", f"""WITH {TOKS}, {COUNTS}, {KNOWN}, {_SUGGEST}, n2 AS (SELECT count(*) AS c FROM m ANTI JOIN sg ON sg.anchor = m.anchor), ok AS (SELECT (SELECT c FROM n2) <= (SELECT count(*) FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_returnflag = 'N')) AS ok)
    SELECT m.anchor, CASE WHEN suggestion IS NOT NULL THEN 'spell_corrected_to_existing' WHEN (SELECT ok FROM ok) THEN 'assigned' ELSE 'unresolved' END AS action, CASE WHEN suggestion IS NOT NULL THEN suggestion WHEN (SELECT ok FROM ok) THEN m.anchor END AS resolved_to FROM m LEFT JOIN sg ON sg.anchor = m.anchor""")
def _(spark, sf):
    return curation.resolved(missing(spark, sf).withColumnRenamed("n", "observations"), known(spark, sf), slots(spark, sf))


@query("d11_phrase_symbols", "SELECT DISTINCT p_name AS phrase, '0x30' || upper(left(sha256(lower(trim(p_name))), 8)) AS symbol FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("phrase")).distinct().select("phrase", S.label_symbol(F.col("phrase")).alias("symbol"))


@query("h1_labels", "SELECT DISTINCT n_name AS label, '0x08' || upper(left(sha256(lower(trim(n_name))), 8)) AS core, '0x5C' || upper(left(sha256(lower(trim(n_name))), 8)) AS future FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("label")).distinct().select("label", S.label_symbol(F.col("label"), "core", 2).alias("core"), S.label_symbol(F.col("label"), "future", 9).alias("future"))


@query("h11_rebuild", """WITH w AS (SELECT source AS word, 1 AS pack FROM documents UNION ALL SELECT upper(source), 2 FROM documents UNION ALL SELECT n_name, 3 FROM nation),
    d AS (SELECT word, lower(word) AS f, row_number() OVER (PARTITION BY lower(word) ORDER BY pack, word) AS k FROM w), u AS (SELECT DISTINCT word FROM d WHERE k = 1)
    SELECT (SELECT count(*) FROM w)::BIGINT AS source_rows, (SELECT count(*) FROM u)::BIGINT AS unique_rows, ((SELECT count(*) FROM w) - (SELECT count(*) FROM u))::BIGINT AS duplicates, (SELECT count(*) FROM u)::BIGINT AS symbols, 0::BIGINT AS bad_symbols""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    packs = [d.select(F.col("source").alias("word"), F.lit(1).alias("pack")), d.select(F.upper("source").alias("word"), F.lit(2).alias("pack")), table(spark, sf, "nation").select(F.col("n_name").alias("word"), F.lit(3).alias("pack"))]
    return lexicon.rebuilt(packs[0].unionByName(packs[1]).unionByName(packs[2]), ["pack", "word"])[1]


@query("h12_letters", """WITH w AS (SELECT DISTINCT p_name AS word FROM part) SELECT upper(regexp_extract(lower(word), '\\p{L}')) AS letter, word, (row_number() OVER (PARTITION BY upper(regexp_extract(lower(word), '\\p{L}')) ORDER BY lower(word), word))::INT AS place FROM w""")
def _(spark, sf):
    return lexicon.by_letter(table(spark, sf, "part").select(F.col("p_name").alias("word")).distinct())


@query("p18_windows", f"""WITH {TOKS}, s AS (SELECT source_id, list(anchor ORDER BY pos) AS a FROM toks GROUP BY source_id), o AS (SELECT source_id, a, unnest(range(1, len(a) + 1)) AS p FROM s)
    SELECT source_id, count(*)::BIGINT AS occurrences, {_hash("p - 1", "a[p]", "array_to_string(a[greatest(1, p - 6):p - 1], ' ')", "array_to_string(a[p + 1:p + 6], ' ')")} AS digest FROM o GROUP BY source_id""")
def _(spark, sf):
    rows = curation.windows(relations.paragraph_anchors(docs(spark, sf), whole=True))
    digest = rows_hash(F.col("position"), F.col("anchor"), F.array_join("before", " "), F.array_join("after", " "))
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("occurrences"), F.sum(digest).alias("digest"))


@query("p20_nulls", f"WITH {TOKS} SELECT source_id, pos AS position, anchor FROM toks WHERE anchor IN ({_GLUE_SQL})")
def _(spark, sf):
    nulls = spark.createDataFrame([(g,) for g in phrases.GLUE], "anchor string")
    return curation.null_index(relations.placed_anchors(docs(spark, sf)), nulls).select("source_id", F.col("position").cast("long").alias("position"), "anchor")


@query("z96_seed", f"WITH {TOKS}, {COUNTS} SELECT anchor, n FROM cnt WHERE length(anchor) > 2 AND anchor NOT IN ({_GLUE_SQL}) ORDER BY n DESC, anchor LIMIT 1")
def _(spark, sf):
    rows = relations.token_counts(docs(spark, sf)).where((F.char_length("anchor") > 2) & ~F.col("anchor").isin(phrases.GLUE))
    return rows.agg(F.min_by(F.struct("anchor", "n"), F.struct((-F.col("n")).alias("m"), "anchor")).alias("s")).select("s.*")


@query("z6_cloud_shape", f"""WITH {TOKS} SELECT source_id, count(*)::BIGINT AS anchors, count_if(anchor IN ({_GLUE_SQL}))::BIGINT AS nulls, round(count_if(anchor NOT IN ({_GLUE_SQL})) / count(*), 6) AS ratio FROM toks GROUP BY source_id""")
def _(spark, sf):
    rows = relations.placed_anchors(docs(spark, sf)).groupBy("source_id").agg(F.count(F.lit(1)).alias("anchors"), F.count_if(F.col("anchor").isin(phrases.GLUE)).alias("nulls"))
    return rows.withColumn("ratio", F.round((F.col("anchors") - F.col("nulls")) / F.col("anchors"), 6))


@query("z3_positions", f"WITH {TOKS} SELECT source_id, pos AS position FROM toks WHERE anchor = 'the'")
def _(spark, sf):
    return relations.placed_anchors(docs(spark, sf)).where("anchor = 'the'").select("source_id", F.col("position").cast("long").alias("position"))


@query("z4_candidates", f"""WITH {TOKS}, {PAIRS} SELECT neighbor, sum(observations)::BIGINT AS n, neighbor IN ({_GLUE_SQL}) AS blocked FROM rel WHERE anchor IN ({_ASK}) GROUP BY neighbor""")
def _(spark, sf):
    rel = relations.corpus_relations(docs(spark, sf), asked=QUESTION)
    return rel.groupBy("neighbor").agg(F.sum("observations").alias("n")).withColumn("blocked", F.col("neighbor").isin(phrases.GLUE))


@query("z5_top", f"""WITH {TOKS}, {PAIRS}, z AS MATERIALIZED (SELECT anchor, neighbor, sum(observations)::BIGINT AS n FROM rel GROUP BY ALL)
    SELECT neighbor, sum(n)::BIGINT AS n FROM z WHERE anchor IN ({_ASK}) AND neighbor NOT IN ({_GLUE_SQL}) GROUP BY neighbor ORDER BY n DESC, neighbor LIMIT 25""")
def _(spark, sf):
    rel = relations.corpus_relations(docs(spark, sf)).where(F.col("anchor").isin(QUESTION) & ~F.col("neighbor").isin(phrases.GLUE))
    return rel.groupBy("neighbor").agg(F.sum("observations").alias("n")).orderBy(F.desc("n"), "neighbor").limit(25)


@query("a32_evidence", f"WITH {TOKS}, {PAIRS} SELECT anchor, sum(observations)::BIGINT AS total FROM rel WHERE anchor IN ({_ASKED}) GROUP BY anchor ORDER BY total DESC, anchor LIMIT 8")
def _(spark, sf):
    rel = relations.corpus_relations(docs(spark, sf), asked=ASKED)
    return rel.groupBy("anchor").agg(F.sum("observations").alias("total")).orderBy(F.desc("total"), "anchor").limit(8)


@query("a12_resonance", f"""WITH {TOKS}, {PAIRS} SELECT source_id, count(DISTINCT anchor)::BIGINT AS anchors, count(*)::BIGINT AS relations, sum(observations)::BIGINT AS observations, round(sum(observations) / count(DISTINCT anchor), 6) AS mean FROM rel GROUP BY source_id""")
def _(spark, sf):
    return context.resonance_summary(relations.relations(docs(spark, sf)))


@query("z37_relation_rows", f"""WITH {TOKS}, {PAIRS}, f AS (SELECT anchor, "offset", neighbor, sum(observations)::BIGINT AS n FROM rel GROUP BY ALL) SELECT anchor, "offset", neighbor, n FROM f ORDER BY n DESC, anchor, "offset", neighbor LIMIT 200""")
def _(spark, sf):
    return relations.corpus_relations(docs(spark, sf)).withColumnRenamed("observations", "n").orderBy(F.desc("n"), "anchor", "offset", "neighbor").limit(200)


@query("z38_anchor_rows", f"WITH {TOKS}, {COUNTS} SELECT anchor, n FROM cnt ORDER BY n DESC, anchor LIMIT 25")
def _(spark, sf):
    return relations.token_counts(docs(spark, sf)).orderBy(F.desc("n"), "anchor").limit(25)
