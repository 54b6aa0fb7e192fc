import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import symbols as S
from tessera.functions import text as X
from tessera.operators import context, counts, frames, graph, lexicon, phrases, relations, search


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def anchors(spark, text):
    return [t.anchor for t in one(spark, X.tokens(F.lit(text)))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("don't stop. do not stop 😊", ["don't", "stop", ".", "do", "not", "stop", "__EMOJI__"]),
        ("'em don't girls' rock 'n' roll ’ lone ’", ["em", "don't", "girls'", "rock", "n", "roll", "lone"]),
        ("'apm 'x", ["apm", "x"]),
        ("Earth’s orbit and women's votes", ["earth's", "orbit", "and", "women's", "votes"]),
        ("ABSC v1.1 B70", ["a", "b", "s", "c", "v", "1", ".", "1", "b", "7", "0"]),
        ("high-accuracy value=10 **Limitations:**", ["high", "-", "accuracy", "value", "=", "1", "0", "*", "*", "limitations", ":", "*", "*"]),
        ("876-RT54TX-67%%", list("876-rt54tx-67%%")),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert anchors(spark, text) == want


def test_literal_is_one_uncounted_token(spark):
    long_id = "abc123" * 6
    rows = one(spark, X.tokens(F.lit(f"x {long_id} y")))
    assert [(t.anchor, t.kind, t.count_eligible) for t in rows][1] == (long_id, "string_literal", False)
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []


def rel(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.source_id, r.anchor, r.offset, r.neighbor): r.observations for r in relations.relations(docs, **kw).collect()}


def test_windows_stop_at_paragraphs_and_blocked_tokens_keep_their_place(spark):
    got = rel(spark, [(1, "do not.\r\n \r\nstop now!"), (2, "alpha " + "k9" * 20 + " beta"), (3, None)])
    assert (1, "not", 2, "stop") not in got and got[1, "stop", 1, "now"] == 1
    assert {k[1:] for k in got if k[0] == 2} == {("alpha", 2, "beta"), ("beta", -2, "alpha")}


def test_pairs_of_a_paragraph(spark):
    n = 11
    assert sum(rel(spark, [(1, " ".join(f"w{chr(97 + i)}" for i in range(n)))]).values()) == 12 * n - 42


def test_context_of_repeated_token(spark):
    docs = spark.createDataFrame([(1, "do not do")], "doc_id long, text string")
    r = relations.relations(docs)
    views = {(v.anchor, v.side, v.distance): (v.neighbor, v.n) for v in context.context_views(r).collect()}
    assert views["do", "before", 1] == ("not", 1) and views["do", "after", 2] == ("do", 1)
    index = {x.anchor: (x.centre, x.total) for x in context.anchor_index(relations.token_counts(docs), r).collect()}
    assert index["do"][0] == 2


def test_resolved_root_and_observed_neighbour(spark):
    p = spark.createDataFrame([(1, ["a", "junk", "b"], ["A", "__NULL__", "b"], [True, True, True])], "source_id long, anchors array<string>, resolved array<string>, eligible array<boolean>")
    got = {(r.anchor, r.offset, r.neighbor): r.observations for r in relations.resolved_relations(p).collect()}
    assert got == {("A", 2, "b"): 1, ("b", -2, "a"): 1}


def test_native_score(spark):
    rows = [(1, 1, "AA", 0, 10), (2, 1, "AA", 0, 5), (1, 2, "BB", 0, 20), (2, -1, "CC", 0, 7), (2, 1, "DD", 4, 99)]
    df = spark.createDataFrame(rows, "root int, offset int, neighbor string, lane int, count long")
    assert [(r.neighbor, r.score, r.roots) for r in counts.score(df, [1, 2], [0], 3).collect()] == [("AA", 15.0, 2), ("BB", 10.0, 1), ("CC", 7.0, 1)]


def test_sequences_of_a_stream(spark):
    rows = [("s", i, v, 1 if v == 3 else 0, 0, i in (0, 4), False) for i, v in enumerate([1, 2, 3, 2, 7, 8])]
    df = spark.createDataFrame(rows, "stream_id string, ordinal int, symbol long, lane int, flags int, starts boolean, blocked boolean")
    got = {(r.root, r.offset, r.neighbor, r.lane): r["count"] for r in relations.sequence_relations(df, 2).collect()}
    assert got[2, -1, 1, 0] == 1 and got[2, 1, 3, 1] == 1 and got[2, 2, 2, 0] == 1 and (2, 1, 7, 0) not in got and got[7, 1, 8, 0] == 1


def test_merge_modes(spark):
    cols = "root int, root_lane int, offset int, neighbor string, lane int, flags int, count long"
    a, b = spark.createDataFrame([(1, 0, 1, "x", 0, 0, 2), (2, 0, 1, "x", 0, 0, 3)], cols), spark.createDataFrame([(1, 0, 1, "y", 0, 0, 5), (2, 1, 1, "x", 0, 0, -3)], cols)
    assert {(r.root, r.neighbor): r["count"] for r in counts.merge_into(a, b.limit(1), "replace").collect()} == {(1, "y"): 5, (2, "x"): 3}
    assert {(r.root, r.neighbor): r["count"] for r in counts.merge_into(a, b.limit(1)).collect()} == {(1, "x"): 2, (1, "y"): 5, (2, "x"): 3}
    assert [r.root for r in counts.root_lane_conflicts(a.union(b)).collect()] == [2]


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "newton laws of motion"), (2, "newton laws of motion"), (3, "of the and field of motion field of motion")], "doc_id long, text string")
    got = {r.phrase: r for r in phrases.scored(phrases.candidates(phrases.ngrams(phrases.streams(docs), 2, 4))).collect()}
    best = got["newton laws of motion"]
    assert (best.occurrences, best.sources) == (2, 2) and best.score > got["laws of motion"].score
    assert "of the" not in got and "field of motion" in got


def test_cloud(spark):
    docs = spark.createDataFrame([(1, "basement creatures basement evil basement creatures")], "doc_id long, text string")
    members = {r.neighbor for r in context.context_clouds(relations.relations(docs), 0.3).where("anchor = 'basement'").collect()}
    assert "creatures" in members


def test_lexicon(spark):
    a = lambda *w: spark.createDataFrame([(x,) for x in w], "anchor string")
    sug = {r.anchor: r.suggestion for r in lexicon.suggestions(a("heat", "cats", "zzz", "bat"), a("heats", "cat", "cots", "bit", "but")).collect()}
    assert sug == {"heat": "heats", "cats": "cots"}
    lanes = {w: one(spark, lexicon.lane(F.lit(w))) for w in ["", "<mi>", "ch12_x", "mrow", "∞", "cosine", "href", "Ãx", "walrus", "x!", "ab", "sqrt", "rques"]}
    assert [lexicon.LANES.index(v) for v in lanes.values()] == [7, 7, 5, 2, 1, 1, 4, 7, 0, 7, 7, 3, 6]
    slots = spark.createDataFrame([(3,), (1,)], "slot int")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    assert {tuple(r) for r in lexicon.assign(words("b", "a", "k"), slots, words("k")).collect()} == {("a", 1), ("b", 3)}
    assert lexicon.assign(words("a", "b", "c"), slots, words("k")).count() == 0
    assert {tuple(r) for r in lexicon.allocate(a("b", "a", "c")).collect()} == {("a", S.CORE), ("b", S.CORE + 1), ("c", S.CORE + 2)}


def test_symbols(spark):
    assert one(spark, S.symbol_hex(F.lit(0x1000000007))) == "0x1000000007" and one(spark, S.symbol_of_hex(F.lit("0x1000000007"))) == 0x1000000007
    assert bytes(one(spark, S.symbol_bytes(F.lit(258)))) == b"\0\0\0\1\2"
    assert one(spark, S.grid_bits(F.lit(5)))[-3:] == [1, 0, 1]


def test_search(spark):
    span = lambda text, *q: one(spark, search.proximity_span(F.split(F.lit(text), " "), list(q)))
    assert span("a x x b a", "a", "b") == 2 and span("a x", "a", "b") is None and span("a", "a") is None
    m = spark.createDataFrame([(1, 1, "Cats like dogs"), (1, 2, "cat"), (2, 1, None)], "conv_id int, turn int, text string")
    assert [(r.conv_id, r.turn) for r in search.chat_search(m, "cats dog").collect()] == [(1, 1)]
    assert [(r.turn, r.score) for r in search.chat_search(m, "cats dog", "any").collect()] == [(1, 202), (2, 101)]
    assert search.chat_search(m, "!!").count() == 0
    assert float(one(spark, search.force_answer(F.lit("a mass of 2 kg at 3.5 m/s^2")))) == 7.0
    assert one(spark, search.excerpt(F.lit("x" * 300 + "needle" + "y" * 900), ["needle"])).index("needle") == 180


def test_walk(spark):
    e = spark.createDataFrame([("e", "a", "b"), ("e", "b", "c"), ("e", "c", "d"), ("e", "a", "x")], "type string, a string, b string")
    assert [(r.id, r.depth) for r in graph.walk(e, "a", 2).collect()] == [("a", 0), ("b", 1), ("x", 1), ("c", 2)]
    assert graph.walk(e, "a", 4, limit=3).count() == 3


def test_frame_features_match_expressions(spark):
    r = np.random.default_rng(0)
    rows = [(s, n, r.random(16).tolist()) for s in ("a", "b") for n in range(5)]
    df = spark.createDataFrame(rows, "stream_id string, frame_number long, cells array<double>")
    series = {(x.stream_id, x.frame_number): x for x in frames.feature_series(df, 4, 4).collect()}
    assert series["a", 0].static_ratio == 1.0 and series["a", 0].energy_total == 0.0 and series["b", 1].stutter_score == 0.0 and series["b", 2].stutter_score > 0
    for e in frames.energy(df).collect():
        s = series[e.stream_id, e.frame_number]
        if e.frame_number:
            assert (e.energy_total, e.energy_std, e.motion_concentration_50, e.static_ratio) == pytest.approx((s.energy_total, s.energy_std, s.motion_concentration_50, s.static_ratio))
    big = frames.upsample(df, 4, 4, 2).first().cells
    assert len(big) == 64 and big[0] == big[1] == big[8] == big[9]


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming.frame_stream import feature_stream

    r = np.random.default_rng(1)
    rows = [(s, n, r.random(16).tolist()) for n in range(6) for s in ("a", "b")]
    schema = "stream_id string, frame_number long, cells array<double>"
    for k in range(3):
        spark.createDataFrame(rows[k * 4 : k * 4 + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = feature_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 4, 4).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    key = lambda x: (x.stream_id, x.frame_number)
    want = frames.feature_series(spark.createDataFrame(rows, schema), 4, 4).collect()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda t: t[:2]) == sorted(map(tuple, want), key=lambda t: t[:2]) and key
