"""Facts of passages, grounded answers and the cascade."""

from pyspark.sql import functions as F

from tessera.plans import grounded as G

BLOCKS = [
    ("a", 0, "Question: What is force? Answer: Force is mass times acceleration. Question: What is mass? Answer: An amount of matter."),
    ("a", 1, "Notes. Compact Answer Field - tides follow the moon"), ("b", 0, "# Lesson about force"), ("b", 1, "The moon pulls the   sea and force moves it."), ("b", 2, "```\nforce = m * a\n```"), ("b", 3, ""), ("c", 0, None),
]


def test_fact_texts(spark):
    df = spark.createDataFrame(BLOCKS, "source_id string, block_id int, text string")
    got = {(r.source_id, r.block_id): [(f.fact, f.kind) for f in r.f] for r in df.select("source_id", "block_id", G.fact_texts(F.col("text")).alias("f")).collect()}
    assert got["a", 0] == [("Force is mass times acceleration.", "qa_answer"), ("An amount of matter.", "qa_answer")]
    assert got["a", 1] == [("tides follow the moon", "compact_answer")] and got["b", 1] == [("The moon pulls the sea and force moves it.", "source_block")]
    assert got["b", 0] == got["b", 2] == got["b", 3] == got["c", 0] == []


def test_grounded_answers(spark):
    blocks = spark.createDataFrame(BLOCKS, "source_id string, block_id int, text string")
    queries = spark.createDataFrame([(1, "what is force".split(), ["acceleration"]), (2, "why moon tides".split(), []), (3, ["zebra"], ["stripes"]), (4, [], []), (5, ["the"], [])], "query_id long, anchors array<string>, terms array<string>")
    found = G.passages(queries, blocks)
    assert {r.query_id for r in found.collect()} == {1, 2}
    got = [r for r in G.facts(queries, found, blocks).orderBy("query_id", "rank").collect()]
    one = [r for r in got if r.query_id == 1]
    assert one[0].fact == "Force is mass times acceleration." and one[0].query_hits == 3 and one[0].term_hits == 1 and one[0].score == round(335 + 75 + [p.score for p in found.collect() if (p.query_id, p.source_id, p.block_id) == (1, "a", 0)][0] / 10, 6)
    assert "An amount of matter." not in {r.fact for r in one}
    rows = {r.query_id: r for r in G.grounded(queries, blocks).collect()}
    assert rows[1].grounded and rows[1].citations[0] == "a:block0" and rows[2].answer == "tides follow the moon" and rows[2].citations == ["a:block1", "b:block1"]
    assert not rows[3].grounded and rows[3].answer == "Zebra involves stripes." and rows[4].answer == "" and rows[3].citations == []


def test_the_cascade(spark):
    texts = {1: "line\n" * 20, 2: "What force moves 2 kg at 3 m/s^2?", 3: "in documents", 4: "in counts", 5: "in memory", 6: "nowhere", 7: None, 8: "in both"}
    rows = lambda ids: spark.createDataFrame([(i, f"from {n}") for i, n in ids], "query_id long, answer string")
    got = G.routed(spark.createDataFrame(list(texts.items()), "query_id long, text string"), rows([(3, "d"), (8, "d"), (1, "d")]), rows([(4, "c"), (8, "c"), (2, "c")]), rows([(5, "m"), (4, "m")]).unionByName(spark.createDataFrame([(6, "")], "query_id long, answer string")))
    assert {r.query_id: (r.tier, r.answer) for r in got.collect()} == {
        1: ("document_payload", None), 2: ("formula", "6 N"), 3: ("documents", "from d"), 4: ("counts", "from c"), 5: ("memory", "from m"), 6: ("unanswered", None), 7: ("unanswered", None), 8: ("documents", "from d")}
