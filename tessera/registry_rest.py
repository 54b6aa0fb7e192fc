"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import symbols as S
from tessera.functions import text as X
from tessera.operators import context, dedupe, frames, graph, inference, lexicon, phrases, qa, questions, relations, reports, search
from tessera.plans.walk import plan_confidence
from tessera.registry import _FOLD, _GLUE_SQL, _GRAMS, ASKED, COUNTS, KNOWN, PAIRS, TOKS, docs, grids, known, query, table
from tessera.registry_questions import CATEGORIES
from tessera.sources import counts_json, steps

_ASKED = ", ".join(f"'{a}'" for a in ASKED)


@query("p3_strings", f"WITH {TOKS} SELECT source_id, string_agg(anchor, ' ' ORDER BY pos) AS tokens FROM toks GROUP BY source_id")
def _(spark, sf):
    rows = docs(spark, sf).select(F.col("doc_id").alias("source_id"), X.surfaces(F.col("text")).alias("s")).where(F.size("s") > 0)
    return rows.select("source_id", F.array_join(X.anchors(F.col("s")), " ").alias("tokens"))


@query("p4_kinds", rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\S+')) AS r FROM documents), l AS (SELECT doc_id, r, length(r) >= 32 AND regexp_matches(r, '\p{{L}}') AND regexp_matches(r, '\p{{Nd}}') AS lit FROM t),
    p AS (SELECT doc_id, lit, unnest(CASE WHEN lit THEN [r] ELSE regexp_extract_all(r, '\p{{L}}+|[^\s\p{{L}}]') END) AS x FROM l),
    k AS (SELECT doc_id, CASE WHEN lit THEN 'string_literal' WHEN regexp_full_match(x, '\p{{L}}{{2,}}') AND upper(x) = x THEN 'letter' WHEN regexp_matches(x, '^\p{{L}}') THEN 'word' WHEN regexp_full_match(x, '\p{{Nd}}') THEN 'digit' ELSE 'symbol' END AS kind, x FROM p)
    SELECT kind, sum(CASE WHEN kind = 'letter' THEN length(x) ELSE 1 END)::BIGINT AS n FROM k GROUP BY kind""")
def _(spark, sf):
    return relations.token_rows(docs(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("p19_ids", "SELECT c_custkey, 'x_' || left(sha256(c_custkey || '::' || c_name), 16) AS id FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.stable_id("x", F.col("c_custkey"), F.col("c_name")).alias("id"))


@query("f8_glue_only", f"WITH w AS (SELECT doc_id, string_split(lower(text), ' ')[1:3] AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_filter(w, lambda x: x NOT IN ({_GLUE_SQL}))) = 0 AS glue FROM w")
def _(spark, sf):
    words = F.slice(F.split(F.lower("text"), " "), 1, 3)
    return docs(spark, sf).where(F.col("text").isNotNull()).select("doc_id", phrases.glue_only(words).alias("glue"))


@query("f9_surface", rf"WITH {TOKS}, {COUNTS} SELECT anchor, anchor <> '__null__' AND NOT (starts_with(anchor, 'u') AND length(anchor) >= 8) AND regexp_matches(anchor, '[\p{{L}}\p{{N}}]') AS kept FROM cnt")
def _(spark, sf):
    return relations.token_counts(docs(spark, sf)).select("anchor", phrases.surface_token(F.col("anchor")).alias("kept"))


@query("f11_preview", "SELECT doc_id, contains(t, 'e') AND contains(t, 'n') AND contains(t, ' the ') AND contains(t, '.') AND contains(t, ',') AS refused FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.holds_all(F.col("text"), ["e", "n", " the ", ".", ","]).alias("refused"))


@query("f15_policy", "SELECT n_regionkey::VARCHAR AS list, array_to_string(list_sort(list_distinct(list(lower(trim(n_name))))), ' ') AS symbols FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("list"), F.col("n_name").alias("symbol"))
    return questions.policy(rows).withColumn("symbols", F.array_join("symbols", " "))


@query("f16_code", "SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AS code FROM part")
def _(spark, sf):
    text = F.concat(F.when(F.col("p_size") % 2 == 0, " ```py\n").otherwise("say ```"), "p_name", F.when(F.col("p_size") % 3 == 0, "\nAnswer: x").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", questions.code_only(text).alias("code"))


@query("j12_near", "SELECT a.n_name AS a, b.n_name AS b, CASE WHEN levenshtein(a.n_name, b.n_name) <= 1 THEN levenshtein(a.n_name, b.n_name) ELSE -1 END::INT AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(spark, sf):
    n = table(spark, sf, "nation")
    other = n.select("n_regionkey", F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))
    return n.join(other, "n_regionkey").where("n_nationkey < k").select(F.col("n_name").alias("a"), "b", F.levenshtein("n_name", "b", 1).alias("d"))


@query("j25_degrees", "SELECT doc_id::VARCHAR AS id, len(string_split(text, chr(10)))::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    _n, edges = graph.document_graph(docs(spark, sf))
    return graph.adjacency(edges.where("type = 'document-line'")).where(~F.col("a").contains("/")).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("a15_stability", f"WITH {TOKS}, {_GRAMS} SELECT phrase, stability FROM cand WHERE n = 2")
def _(spark, sf):
    return phrases.mined(phrases.streams(docs(spark, sf)), 2, 2).select("phrase", "stability")


@query("z27_candidates", f"WITH {TOKS}, {_GRAMS} SELECT phrase, n, occurrences, sources FROM cand WHERE occurrences >= 3 ORDER BY occurrences DESC, phrase LIMIT 500")
def _(spark, sf):
    rows = phrases.mined(phrases.streams(docs(spark, sf)), min_count=3)
    return rows.select("phrase", "n", "occurrences", "sources").orderBy(F.desc("occurrences"), "phrase").limit(500)


@query("a26_hashes", "SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS hash FROM documents")
def _(spark, sf):
    return dedupe.content_duplicates(table(spark, sf, "documents")).select("doc_id", "hash")


@query("a29_trials", "SELECT count(*)::BIGINT AS pages, round(avg(l_discount::DOUBLE), 9) AS mean_agreement, count_if(l_discount = 1)::BIGINT AS exact_pages, round(count(*) / sum(l_quantity::DOUBLE), 9) AS pages_per_second FROM lineitem")
def _(spark, sf):
    got = reports.trial_rollup(table(spark, sf, "lineitem").select(F.col("l_discount").cast("double").alias("ratio"), F.col("l_quantity").cast("double").alias("seconds")))
    return got.select("pages", F.round("mean_agreement", 9).alias("mean_agreement"), "exact_pages", F.round("pages_per_second", 9).alias("pages_per_second"))


@query("a34_folders", "SELECT p_brand AS folder, count(*)::BIGINT AS files, sum(p_size)::BIGINT AS bytes FROM part GROUP BY p_brand")
def _(spark, sf):
    return reports.folder_index(table(spark, sf, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("size")))


@query("a37_renderer", "SELECT round(avg((p_size % 2 = 0)::INT), 9) AS exact, round(avg(((p_size % 5 = 0) = (p_size % 3 = 0))::INT), 9) AS refusals, count_if(p_size % 5 <> 0 AND p_size % 7 = 0)::BIGINT AS leaks FROM part")
def _(spark, sf):
    size = F.col("p_size")
    told = F.when(size % 5 == 0, "").otherwise(F.concat(F.lit("said "), F.when(size % 7 == 0, "secret").otherwise("x")))
    rows = table(spark, sf, "part").select(F.when(size % 2 == 0, told).otherwise("other").alias("want"), told.alias("got"), (size % 3 == 0).alias("must_refuse"), F.lit("secret").alias("secret"))
    got = reports.renderer_scores(rows)
    return got.select(F.round("exact", 9).alias("exact"), F.round("refusals", 9).alias("refusals"), "leaks")


@query("i7_role_fit", "SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 6 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 6 ELSE 0 END + CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 6 ELSE 0 END + 6)::INT AS fit FROM part")
def _(spark, sf):
    size = F.col("p_size")
    roles = F.array_compact(F.array(F.when(size % 2 == 0, "action_candidate"), F.when(size % 3 == 0, "object_candidate"), F.lit("content_anchor"), F.lit("content_anchor")))
    return table(spark, sf, "part").select("p_partkey", inference.role_fit(roles).cast("int").alias("fit"))


@query("i14_confidence", "SELECT p_partkey, round(least(0.92::DOUBLE, 0.55::DOUBLE + p_size / 50 * 0.3::DOUBLE) - least(0.12::DOUBLE, (p_size % 7) * 0.03::DOUBLE), 6) AS confidence FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(plan_confidence(F.col("p_size") / 50, F.col("p_size") % 7), 6).alias("confidence"))


@query("i15_force", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN (p_size * (p_partkey % 9 + 0.5))::DOUBLE END AS force FROM part")
def _(spark, sf):
    text = F.concat(F.lit("What force moves "), "p_size", F.lit(" kg "), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("at "), F.col("p_partkey") % 9, F.lit(".5 m/s^2?"))).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", search.force_answer(text).cast("double").alias("force"))


@query("i16_score", "SELECT p_partkey, round(p_size / 50 * 0.45::DOUBLE + 0.25::DOUBLE * 0.5::DOUBLE + (p_size % 2) * 0.2::DOUBLE + 0.1::DOUBLE, 6) AS score FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(inference.match_score(F.col("p_size") / 50, F.lit(0.5), F.col("p_size") % 2, F.lit(1.0)), 6).alias("score"))


@query("h7_symbols", f"WITH {KNOWN} SELECT anchor, symbol::BIGINT AS symbol, lpad(upper(to_hex(symbol)), 10, '0') AS bytes FROM lex")
def _(spark, sf):
    rows = known(spark, sf).withColumn("told", S.symbol_hex(F.col("symbol")))
    return rows.select("anchor", S.symbol_of_hex(F.col("told")).alias("symbol"), F.hex(S.symbol_bytes(F.col("symbol"))).alias("bytes"))


@query("h3_pool", "SELECT n_name AS anchor, (68719476736 + 100 + row_number() OVER (ORDER BY n_name) - 1)::BIGINT AS symbol FROM nation")
def _(spark, sf):
    return lexicon.allocate(table(spark, sf, "nation").select(F.col("n_name").alias("anchor")), 100)


@query("d2_assign_one", "SELECT 'new word' AS word, min(s_suppkey)::BIGINT AS slot FROM supplier")
def _(spark, sf):
    one = spark.createDataFrame([("new word",)], "word string")
    return lexicon.assign(one, table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("slot")), one.limit(0))


@query("z33_buckets", f"""WITH {TOKS}, {PAIRS}, f AS (SELECT anchor, "offset", neighbor, sum(observations)::BIGINT AS n FROM rel WHERE anchor IN ({_ASKED}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY anchor, "offset" ORDER BY n DESC, neighbor) AS k FROM f)
    SELECT anchor, "offset", string_agg(neighbor || ':' || n, ' ' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY ALL""")
def _(spark, sf):
    rows = context.context_views(relations.corpus_relations(docs(spark, sf)).where(F.col("anchor").isin(ASKED)), 3)
    offset = F.when(F.col("side") == "before", -F.col("distance")).otherwise(F.col("distance"))
    told = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "neighbor", F.col("n").cast("string")).alias("t"))))
    return rows.groupBy("anchor", offset.cast("int").alias("offset")).agg(F.array_join(F.transform(told, lambda x: x.t), " ").alias("top"))


@query("z41_spell_buckets", rf"""WITH {KNOWN} SELECT replace(upper(CASE WHEN regexp_extract(anchor, '\p{{L}}') = '' THEN 'A' ELSE regexp_extract(anchor, '\p{{L}}') END), 'ẞ', 'SS') AS letter, length(anchor)::INT AS length, count(*)::BIGINT AS n FROM lex GROUP BY ALL""")
def _(spark, sf):
    return known(spark, sf).groupBy(X.letter_bucket(F.col("anchor")).alias("letter"), F.char_length("anchor").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("z81_feature", "SELECT 'value' AS feature, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, round(avg(value::DOUBLE), 6) AS mean, count(value)::BIGINT AS n FROM events")
def _(spark, sf):
    return frames.summary(table(spark, sf, "events").select(F.col("value").cast("double").alias("value")), ["value"]).withColumn("mean", F.round("mean", 6))


@query("z82_clean", "SELECT label::VARCHAR AS stream_id, vec_id AS frame_number, len(list_filter(embedding, lambda x: x < 0))::INT AS nulls, round(list_sum(list_filter(embedding::DOUBLE[], lambda x: x >= 0)), 6) AS screen_energy FROM embeddings")
def _(spark, sf):
    g = grids(spark, sf).withColumn("cells", F.transform("cells", lambda x: F.when(x < 0, float("nan")).otherwise(x)))
    got = frames.clean_vector(g)
    return got.select("stream_id", "frame_number", F.size(F.filter("cells", lambda x: x.isNull())).alias("nulls"), F.round("screen_energy", 6).alias("screen_energy"))


@query("z54_preview", f"WITH {TOKS} SELECT source_id, pos AS position, anchor FROM toks WHERE pos < 12")
def _(spark, sf):
    rows = relations.placed_anchors(docs(spark, sf)).select("source_id", F.col("position").cast("long").alias("position"), "anchor")
    return search.preview(rows, ["source_id"], ["position"])


@query("z69_support", f"""SELECT CASE WHEN regexp_matches(q, '^(why|how|what|which|who|when|where|does) ') THEN split_part(q, ' ', 1) WHEN regexp_matches(q, '^(compare|contrast) ') THEN 'compare' ELSE 'open' END AS cloud_key, count(*)::BIGINT AS source_examples
    FROM (SELECT trim({_FOLD.format("lower(coalesce(text, ''))")}) AS q FROM conversations) GROUP BY 1""")
def _(spark, sf):
    keys = table(spark, sf, "conversations").groupBy(questions.cloud_key(F.col("text")).alias("cloud_key")).agg(F.count(F.lit(1)).alias("source_examples"))
    path = steps.new_folder(spark)
    keys.agg(F.to_json(F.struct(F.collect_list(F.struct("cloud_key", "source_examples")).alias("rules"))).alias("value")).write.text(path)  # ten keys at most
    return counts_json.read_support(spark, path)


@query("z75_organised", """SELECT category, count(*)::BIGINT AS n FROM (SELECT CASE WHEN contains(h, 'license') OR contains(h, 'copyright') THEN 'license' WHEN contains(h, ' und ') OR contains(h, ' der ') THEN 'german'
    WHEN contains(h, ' que ') OR contains(h, ' de la ') THEN 'spanish' ELSE 'general_documents' END AS category FROM (SELECT coalesce(source, '') || chr(10) || coalesce(text, '') AS h FROM documents)) GROUP BY category""")
def _(spark, sf):
    """Documents in a folder for each category, and what lies there."""
    path = steps.new_folder(spark)
    docs(spark, sf).withColumn("category", questions.content_category(F.col("source"), F.col("text"), CATEGORIES, "general_documents")).write.partitionBy("category").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("category").cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("z91_graphs", f"WITH {TOKS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT ((SELECT count(*) FROM documents) + (SELECT count(*) FROM l) + (SELECT count(*) FROM toks) + (SELECT count(DISTINCT anchor) FROM toks))::BIGINT AS nodes, ((SELECT count(*) FROM l) + 2 * (SELECT count(*) FROM toks))::BIGINT AS edges")
def _(spark, sf):
    nodes, edges = graph.document_graph(docs(spark, sf))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each


@query("z61_last_days", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE > (SELECT max(o_orderdate::DATE) FROM orders) - INTERVAL 7 DAY")
def _(spark, sf):
    return search.last_days(table(spark, sf, "orders"), "o_orderdate").select("o_orderkey")


@query("z24_citations", """SELECT l_orderkey, l_linenumber, l_partkey, l_partkey || ' (block ' || l_linenumber || CASE WHEN l_linenumber = 1 OR l_orderkey = 0 THEN '' WHEN l_linenumber = 2 THEN ', line ' || l_orderkey ELSE ', lines ' || l_orderkey || '-' || (l_orderkey + l_linenumber) END || ')' AS cited FROM lineitem""")
def _(spark, sf):
    n, k = F.col("l_linenumber").cast("long"), F.col("l_orderkey").cast("long")
    last = F.when(n == 1, F.lit(0)).when(n == 2, k).otherwise(k + n)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", search.citation(F.col("l_partkey"), n, F.when(n == 1, F.lit(0)).otherwise(k), last).alias("cited"))


@query("z23_evidence", """WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn = 2 THEN 0 WHEN role = 'assistant' THEN 1 WHEN length(text) > 100 THEN 2 END AS k FROM conversations)
    SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY k, turn))::INT AS place FROM p WHERE k IS NOT NULL""")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    got = search.evidence_order(c, (F.col("role") == "user") & (F.col("turn") == 2), F.col("role") == "assistant", F.char_length("text") <= 100, ["conv_id"], ["turn"])
    return got.select("conv_id", "turn", "place")


@query("p28_reasoning", "SELECT row_index, question, frame FROM (SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS row_index, CASE WHEN role = 'user' THEN trim(text) ELSE '' END AS question, role AS frame FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)) WHERE question <> ''")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("question"), F.col("role").alias("frame"))
    return qa.reasoning_rows(rows, ["conv_id", "turn"])
