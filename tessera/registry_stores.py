"""Queries of series with sessions, stored intake in rounds, answers to many questions and the records of pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import frames, questions, relations
from tessera.plans import ask, grounded
from tessera.plans.rounds import Rounds
from tessera.registry import KNOWN, ORACLE_SQL, PAIRS, TOKS, _hash, _tokens, docs, grids, known, query, rows_hash, table
from tessera.registry_intake import _REL
from tessera.registry_views import _SERIES
from tessera.sources import steps

_ROUND = {"high_to_low_ratio": 4}
_FIRST = {"horizontal_vs_vertical_ratio": 1.0, "tunnel_index": 0.0}


def _rounded(got):
    return got.select("stream_id", "frame_number", *(F.round(c, _ROUND.get(c, 6)).alias(c) for c in frames.FEATURES))


def _all_features() -> str:
    parts = " JOIN ".join(f"({ORACLE_SQL[q]}) {q} {'USING (stream_id, frame_number)' if i else ''}" for i, q in enumerate(("w2_energy", "w3_spatial", "w4_frequency", "w5_derived")))
    cols = ", ".join(f"CASE WHEN row_number() OVER (PARTITION BY stream_id ORDER BY frame_number) = 1 THEN {_FIRST[f]} ELSE {f} END AS {f}" if f in _FIRST else f for f in frames.FEATURES)
    return f"SELECT stream_id, frame_number, {cols} FROM {parts}"


@query("w1_features", _all_features())
def _(spark, sf):
    """All twenty features of every frame; a stream's runs are tasks of their own."""
    return _rounded(frames.feature_series(grids(spark, sf), 8, 8))


@query("w6_sessions", f"""WITH RECURSIVE {_SERIES.replace("label::VARCHAR AS s", "label::VARCHAR || '/' || (vec_id // 100)::VARCHAR AS s").replace("PARTITION BY label", "PARTITION BY label, vec_id // 100")}
    SELECT split_part(s, '/', 1) AS stream_id, f AS frame_number, round(now, 6) AS energy_total, round(hi, 6) AS highfreq_energy, round(CASE WHEN abs(before) > 1e-8 THEN abs(now - before) / (before + 1e-8) ELSE 0 END, 6) AS stutter_score FROM m""")
def _(spark, sf):
    """The series with a session for every hundred frame numbers: each begins with fresh averages."""
    got = frames.feature_series(grids(spark, sf).withColumn("session", F.floor(F.col("frame_number") / 100).cast("string")), 8, 8, "session")
    return got.select("stream_id", "frame_number", *(F.round(c, 6).alias(c) for c in ("energy_total", "highfreq_energy", "stutter_score")))


def interrupted(spark, sf):
    """An intake of four rounds that was stopped after one, taken up again, killed in the third and done by another run."""
    path, d = steps.new_folder(spark), docs(spark, sf)
    lex = steps.settled(known(spark, sf))
    first = Rounds(spark, path, lex)
    first.plan(d, per_round=-(-d.count() // 4))
    first.run(most=1)
    first.stop()
    assert first.run() == "stop requested"
    first.resume()
    first.run(most=1)
    spark.range(1).write.parquet(f"{path}/rounds/2-killed/occurrences")  # what a killed run leaves
    last = Rounds(spark, path, lex)
    assert last.run() == "completed"
    return last


@query("o2_manifest", f"""WITH {TOKS}, r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // ((SELECT count(*) + 3 FROM documents) // 4) AS round FROM documents),
    n AS (SELECT source_id, count(*) AS n FROM toks GROUP BY source_id)
    SELECT round::BIGINT AS round, count(*)::BIGINT AS sources, 0::BIGINT AS failed, coalesce(sum(n), 0)::BIGINT AS occurrences, true AS ok FROM r LEFT JOIN n ON source_id = doc_id GROUP BY round""")
def _(spark, sf):
    return interrupted(spark, sf).manifest().drop("folder")


@query("o2_cells", f"""WITH {TOKS}, {PAIRS}, {KNOWN}, {_REL}, c AS (SELECT symbol_id AS root, "offset", neighbor_symbol_id AS neighbor, sum(n)::BIGINT AS n FROM sr WHERE shared GROUP BY ALL)
    SELECT root, count(*)::BIGINT AS relations, {_hash('"offset"', 'neighbor', 'n')} AS digest FROM c GROUP BY root""")
def _(spark, sf):
    """Counts by root over all rounds of the interrupted intake: those of an intake in one go."""
    return interrupted(spark, sf).tables().cells.groupBy("root").agg(F.count(F.lit(1)).alias("relations"), F.sum(rows_hash(F.col("offset"), F.col("neighbor"), F.col("count"))).alias("digest"))


def user_turns(spark, sf):
    """query_id and tokens of every turn that a user said."""
    said = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    toks = relations.placed_anchors(said, "query_id", "text").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "anchor"))), lambda x: x.anchor).alias("anchors"))
    return said.join(toks, F.col("query_id") == F.col("source_id"), "left").select("query_id", F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors"))


@query("i20_answers")
def _(spark, sf):
    """Every user's turn answered from the corpus's relations in one go: reason, terms, those accepted, and what is said."""
    rel = relations.corpus_relations(docs(spark, sf))
    counts = ask.prepared(rel)
    lex = counts.shape.select("anchor")
    return ask.answers(steps.settled(user_turns(spark, sf)), lex, counts, limit=2)


@query("h9_checksum", """SELECT o_orderkey, sha256('{"date":"' || o_orderdate::DATE || '","key":' || o_orderkey || ',"lines":[' || coalesce(lines, '') || '],"who":{"clerk":' || coalesce('"' || o_orderpriority || '"', 'null') || ',"status":"' || o_orderstatus || '"}}') AS checksum FROM orders
    LEFT JOIN (SELECT l_orderkey, string_agg('{"n":' || l_linenumber || ',"returned":' || (l_returnflag = 'R')::VARCHAR || '}', ',' ORDER BY l_linenumber, l_returnflag = 'R') AS lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def _(spark, sf):
    """Checksums of orders with their lines as canonical JSON; the fields are put together in no order."""
    from tessera.operators import records

    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), (F.col("l_returnflag") == "R").alias("returned")))).alias("lines"))
    o = table(spark, sf, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = o.select(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("clerk")).alias("who"), F.coalesce("lines", F.array().cast(o.schema["lines"].dataType)).alias("lines"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("date"))
    return records.checksums(rows).select(F.col("key").alias("o_orderkey"), "checksum")


@query("f18_contracts", """WITH p AS (SELECT page_id, page_id % 5 AS k FROM pages) SELECT page_id, CASE k WHEN 1 THEN 'region map: coordinate_space is none of native_pixels, grid_cells' WHEN 2 THEN 'region map: writes_allowed allows writes'
    WHEN 3 THEN 'region map: source_hash is missing' WHEN 4 THEN 'region map: regions is no list' ELSE '' END AS faults, 'region_map_' || left(sha256('map@1::' || page_id || '::' || sha256(url)), 16) AS region_map_id FROM p JOIN pages USING (page_id)""")
def _(spark, sf):
    """Empty region maps of all pages, four of five broken in one way, and how each breaks its contract."""
    from tessera.operators import records

    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("visual_record_id"), F.sha2("url", 256).alias("source_hash"))
    maps = records.empty_region_maps(p, "map@1").withColumn("page_id", F.col("visual_record_id").cast("long"))
    k, r = F.col("page_id") % 5, F.col("record")
    broken = (
        F.when(k == 1, F.replace(r, F.lit("native_pixels"), F.lit("inches"))).when(k == 2, F.replace(r, F.lit('"counts":false'), F.lit('"counts":true'))).when(k == 3, F.regexp_replace(r, '"source_hash":"[^"]*",', ""))
        .when(k == 4, F.replace(r, F.lit('"regions":[]'), F.lit('"regions":3'))).otherwise(r)
    )
    return maps.select("page_id", F.array_join(records.faults(broken, records.region_map("map@1")), "; ").alias("faults"), F.get_json_object("record", "$.region_map_id").alias("region_map_id"))


_USERS = _tokens("(SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user') x", "qid", "qt")
_STOPPED = ", ".join("'" + w.replace("'", "''") + "'" for w in questions.ANSWER_STOP)
_FACTS = rf"""{_USERS}, {_tokens("benchmark", "item_id", "bt")},
    q AS (SELECT DISTINCT source_id AS qid, anchor, NOT (anchor IN ({_STOPPED}) OR anchor LIKE '<%' OR anchor LIKE '%>' OR contains(anchor, 'xml') OR regexp_full_match(anchor, '[^\p{{L}}\p{{N}}]') OR regexp_full_match(anchor, '\p{{Nd}}+')) AS c FROM qt),
    b AS (SELECT DISTINCT source_id AS item, anchor FROM bt), bn AS (SELECT item, count(*) AS n FROM b GROUP BY item),
    p AS (SELECT qid, item, count(*) FILTER (WHERE c) AS hits, count(*) AS qh FROM q JOIN b USING (anchor) GROUP BY ALL HAVING count(*) FILTER (WHERE c) > 0),
    ps AS (SELECT qid, item, qh, round(hits * 100 + hits / n, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(hits * 100 + hits / n, 6) DESC, item) AS place FROM p JOIN bn USING (item)),
    ft AS (SELECT item_id AS item, trim(replace(replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 'Question:', ''), 'Answer:', ''), ' -') AS fact FROM benchmark),
    fs AS (SELECT qid AS query_id, item AS source_id, fact, qh AS query_hits, round(qh * 100.0::DOUBLE + score / 10, 6) AS score, place FROM ps JOIN ft USING (item) WHERE place <= 12),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, fact) AS rank FROM fs)"""


def asked(spark, sf):
    """The users' turns as queries without walked terms, and benchmark items as blocks."""
    blocks = table(spark, sf, "benchmark").select(F.col("item_id").alias("source_id"), F.lit(0).alias("block_id"), "text")
    return steps.settled(user_turns(spark, sf).withColumn("terms", F.array().cast("array<string>"))), blocks


@query("z22_facts", f"WITH {_FACTS} SELECT query_id, rank::INT AS rank, source_id, fact, query_hits::INT AS query_hits, score FROM fr WHERE rank <= 6")
def _(spark, sf):
    """The selected fact and five candidates of every user's turn, from benchmark items as passages."""
    queries, blocks = asked(spark, sf)
    return grounded.facts(queries, grounded.passages(queries, blocks), blocks).select("query_id", "rank", "source_id", "fact", "query_hits", "score")


@query("z21_grounded", f"WITH {_FACTS} SELECT query_id, max(fact) FILTER (WHERE rank = 1) AS answer, true AS grounded, string_agg(source_id || ':block0', ' ' ORDER BY rank) AS citations FROM fr WHERE rank <= 6 GROUP BY query_id")
def _(spark, sf):
    got = grounded.grounded(*asked(spark, sf)).where("grounded")
    return got.select("query_id", "answer", "grounded", F.array_join("citations", " ").alias("citations"))


@query("o9_routed", f"""WITH {_FACTS}, m AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, text FROM conversations WHERE role = 'user'),
    d AS (SELECT query_id, fact FROM fr WHERE rank = 1 AND query_hits >= 12), n AS (SELECT source_id AS query_id, count(*) AS n FROM qt GROUP BY source_id HAVING count(*) >= 12),
    s AS (SELECT conv_id * 1000 + turn AS query_id, is_document FROM ({ORACLE_SQL["p29_shape"]}))
    SELECT m.query_id, CASE WHEN is_document THEN 'document_payload' WHEN d.fact IS NOT NULL THEN 'documents' WHEN n.n IS NOT NULL THEN 'counts' WHEN m.turn > 0 THEN 'memory' ELSE 'unanswered' END AS tier,
           CASE WHEN is_document THEN NULL WHEN d.fact IS NOT NULL THEN d.fact WHEN n.n IS NOT NULL THEN n.n || ' tokens' WHEN m.turn > 0 THEN 'after ' || m.turn END AS answer
    FROM m JOIN s USING (query_id) LEFT JOIN d USING (query_id) LEFT JOIN n USING (query_id)""")
def _(spark, sf):
    """Who answers each user's turn: facts with twelve shared tokens, else the number of its tokens from twelve on, else the turns before it."""
    queries, blocks = asked(spark, sf)
    best = grounded.facts(queries, grounded.passages(queries, blocks), blocks).where("rank = 1 and query_hits >= 12").select("query_id", F.col("fact").alias("answer"))
    n = F.size("anchors")
    counted = queries.where(n >= 12).select("query_id", F.concat(n, F.lit(" tokens")).alias("answer"))
    said = table(spark, sf, "conversations").where("role = 'user'").withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    memory = said.where("turn > 0").select("query_id", F.concat(F.lit("after "), "turn").alias("answer"))
    return grounded.routed(said.select("query_id", "text"), best, counted, memory)
