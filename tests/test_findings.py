"""Inputs on which queries were wrong or too large once."""

import duckdb

import __spark_entry__ as entry


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def by_sql(name, **tables):
    """Rows that a query's SQL gives over Parquet files."""
    c = duckdb.connect()
    for t, path in tables.items():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    done = c.execute(entry.oracle_sql()[name])
    at = [i for _, i in sorted((d[0], i) for i, d in enumerate(done.description))]
    return sorted(tuple(r[i] for i in at) for r in done.fetchall())


def test_audio_sizes_that_read_as_a_rate(spark, tmp_path):
    """Files whose number of bytes ends as the rate is written."""
    path = str(tmp_path / "supplier.parquet")
    spark.createDataFrame([(k,) for k in (1, 7956, 17956, 57956)], "s_suppkey long").coalesce(1).write.parquet(path)
    assert rows(entry.queries()["s22_audio"](spark, str(tmp_path))) == by_sql("s22_audio", supplier=path + "/*.parquet")


def test_phrases_with_one_shuffle(spark, monkeypatch):
    """Equal to the counts by joins: repeated and missing ids, glue, folded letters, short texts, blocks of one key at least."""
    import random

    from tessera.operators import phrases

    r = random.Random(3)
    words = ["the", "of", "and", "a", "ß", "Σς", "x1", "ubbbbbbbbb", ".", "it", "alpha", "beta"]
    texts = [(None if i % 9 == 0 else i % 5, " ".join(r.choices(words, k=r.choice([0, 1, 2, 3, 7, 60])))) for i in range(60)]
    texts += [(7, None), (8, "the of and"), (8, "the of and"), (9, "alpha beta"), (9, "alpha beta")]
    rows_in = phrases.streams(spark.createDataFrame(texts, "doc_id long, text string"))
    for low, high, least in ((2, 5, 2), (3, 4, 5), (2, 2, 1), (2, 4, 3)):
        want = rows(phrases.candidates(phrases.ngrams(rows_in, low, high), least))
        for block in (1, 1 << 18):
            monkeypatch.setattr(phrases, "BLOCK_ROWS", block)
            assert rows(phrases.mined(rows_in, low, high, least)) == want
    assert want
    plan = phrases.mined(rows_in)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan  # rows as read and rows by their first two words; phrases are joined to nothing


def test_phrases_matched_by_what_all_must_have(spark):
    """Against every pair of query and phrase: repeated tokens, short phrases and queries, phrases that lack their last token."""
    import random

    from tessera.operators import inference

    r = random.Random(5)
    queries = [(i, r.choices("abcdef", k=r.choice([0, 1, 2, 4, 9]))) for i in range(60)]
    phrases = [(f"p{i}", r.choices("abcdefgh", k=r.choice([1, 2, 3, 3, 4, 4, 5]))) for i in range(40)]

    def hits(have, asked):
        at = 0
        for a in have:
            at += at < len(asked) and asked[at] == a
        return at

    want = []
    for i, have in queries:
        scored = [(-(h * 10 + len(s)), p, h) for p, s in phrases if (h := hits(have, s)) >= max(2, len(s) - 1)]
        want += [(i, min(scored)[1], min(scored)[2])] if scored else []
    got = inference.match_phrase(spark.createDataFrame(queries, "query_id long, anchors array<string>"), spark.createDataFrame(phrases, "phrase_id string, sequence array<string>"))
    assert sorted(tuple(x) for x in got.select("query_id", "phrase_id", "hits").collect()) == sorted(want)
    # Of phrases that only differ in a last token that nobody said, one row is shipped.
    same = spark.range(500).selectExpr("concat('q', lpad(id, 3, '0')) as phrase_id", "array('a', 'b', concat('z', id)) as sequence")
    few = inference.match_phrase(spark.createDataFrame([(1, ["a", "x", "b"])], "query_id long, anchors array<string>"), same)
    assert [tuple(x) for x in few.collect()] == [(1, "q000", 2)]


def test_asked_roots_alone_are_counted(spark):
    """Queries about stated tokens drop other pairs before they are counted."""
    for name in ("t17_score", "t19_overlay_cloud", "a32_evidence", "z4_candidates"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "arrays_overlap" in plan, name


def test_skim_and_two_hops_by_asked_roots(spark):
    """The rows of asked roots are enough: other roots are never asked for."""
    from tessera.operators import counts, lookahead

    rel = spark.createDataFrame([("z", 1, "b", 5), ("z", 1, "c", 4), ("b", 1, "d", 3), ("d", 1, "e", 2), ("q", 1, "r", 9)], "anchor string, offset int, neighbor string, observations long")
    near, seen = lookahead.totals(rel), []

    def of(front):
        seen.append(front)
        return near.where(near.anchor.isin(front))

    assert lookahead.skim(of, ["z"]) == lookahead.skim(near, ["z"]) == ([["b", "c"], ["d"], ["e"]], "level_3_cap")
    assert seen == [["z"], ["b", "c"], ["d"]]
    roots = [r.anchor for r in counts.two_hop_roots(rel.where("anchor = 'z'"), ["z"]).collect()]
    assert sorted(roots) == ["b", "c", "z"]
    assert rows(counts.two_hop(rel, ["z"]).select(*rel.columns)) == rows(rel.where(rel.anchor.isin(roots)))


def test_intake_sends_a_small_lexicon(spark):
    """Neither tokens nor pairs are shuffled to the words of a small lexicon; with a larger one the rows are the same."""
    from tessera.plans import intake

    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "a cat of the sea")], "doc_id long, text string")
    lex = spark.createDataFrame([("the", 68719476736), ("cat", 68719476737)], "anchor string, symbol long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = intake.build(docs, lex)
        for df in (got.relations, got.occurrences, got.cells):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        small = [rows(getattr(got, t)) for t in ("occurrences", "relations", "cells")]
        intake.SENT_WORDS, most = 1, intake.SENT_WORDS
        try:
            large = intake.build(docs, lex)
            assert [rows(getattr(large, t)) for t in ("occurrences", "relations", "cells")] == small
        finally:
            intake.SENT_WORDS = most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_walk_without_a_shuffle_of_all_edges(spark, monkeypatch):
    """Edges told twice or both ways; the order is that of the nodes from which others are reached."""
    from tessera.operators import graph

    monkeypatch.setattr(graph, "adjacency", lambda edges: (_ for _ in ()).throw(AssertionError("all edges are laid out")))
    edges = spark.createDataFrame([("x", "a", "c"), ("x", "a", "b"), ("y", "b", "a"), ("x", "c", "d"), ("x", "a", "b"), ("x", "d", "e")], "type string, a string, b string")
    assert [tuple(r) for r in graph.walk(edges, "a", 2).collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert [tuple(r) for r in graph.walk(edges, "a", 3, 3).collect()] == [("a", 0), ("b", 1), ("c", 1)]


def test_facts_are_read_once_a_block(spark):
    from tessera.plans import grounded

    blocks = spark.createDataFrame([(1, 0, "Question: what is rust Answer: iron and air"), (2, 0, "iron is heavy")], "source_id long, block_id int, text string")
    queries = spark.createDataFrame([(i, ["iron"], []) for i in range(3)], "query_id long, anchors array<string>, terms array<string>")
    found = spark.createDataFrame([(i, s, 0, 1, 100.0, s) for i in range(3) for s in (1, 2)], "query_id long, source_id long, block_id int, hits long, score double, place int")
    got = grounded.facts(queries, found, blocks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Generate")  # a plan is printed from its end
    assert [(r.query_id, r.rank, r.source_id, r.fact) for r in got.orderBy("query_id", "rank").collect()] == [(i, k, s, f) for i in range(3) for k, s, f in ((1, 1, "iron and air"), (2, 2, "iron is heavy"))]


def test_views_by_source_from_texts(spark, monkeypatch):
    """Equal to the views over all relations: repeated and missing ids, paragraphs, literals, empty texts, small blocks, ties."""
    import random

    from tessera.operators import by_source, context, counts, relations

    r = random.Random(11)
    words = ["the", "of", "Ab", "ABC", "é", "z", ".", "\n\n", "x" * 31 + "7y", "\U0001f600", "don't", "q" * 33]
    texts = [(None if i % 13 == 0 else i % 17, " ".join(r.choices(words, k=r.choice([0, 1, 2, 5, 40, 200])))) for i in range(50)] + [(99, None), (98, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rel = relations.relations(docs)
    views = [(by_source.overlay, counts.overlay), (by_source.positional_profiles, context.positional_profiles), (by_source.directional_resonance, context.directional_resonance), (by_source.context_clouds, context.context_clouds)]
    told = lambda df: sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    for new, old in views:
        want = told(old(rel))
        for block in (1, 50, 1 << 18):
            monkeypatch.setattr(by_source, "BLOCK_TOKENS", block)
            got = new(docs)
            assert set(got.columns) == set(old(rel).columns)
            assert told(got) == want
        assert len(want) > 100


def test_context_views_shuffle_relations_once(spark):
    from tessera.operators import context

    rel = spark.createDataFrame([("a", 1, "b", 2), ("a", 1, "b", 3), ("a", 1, "c", 4), ("b", -1, "a", 5)], "anchor string, offset int, neighbor string, observations long")
    got = context.context_views(rel, 1)
    assert [(r.anchor, r.neighbor, r.n, r.total) for r in got.orderBy("anchor").collect()] == [("a", "b", 5, 9), ("b", "a", 5, 5)]
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1
