from pyspark.sql import functions as F

from tessera.operators import edits, inference, qa, questions, relations, reports, visual
from tessera.plans.answers import document_answer
from tessera.sources import binary, counts_json, sinks


def test_sinks_and_json_counts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id long, text string")
    rel = relations.corpus_relations(docs)
    sinks.write_relations(rel, f"{tmp_path}/rel", 4)
    got = {tuple(r) for r in sinks.read_relations(spark, f"{tmp_path}/rel", ["b"], 4).collect()}
    assert got == {tuple(r) for r in rel.where("anchor = 'b'").collect()} and len(got) == 3
    m = sinks.write_review(rel, f"{tmp_path}/review")
    assert m["rows"] == rel.count() and m["checksum"] == sinks.write_review(rel.orderBy("neighbor"), f"{tmp_path}/again")["checksum"]
    cells = spark.createDataFrame([(5, 0, 1, 6, 0, 0, 3), (5, 0, -1, 7, 0, 0, 2)], "root long, root_lane int, offset int, neighbor long, lane int, flags int, count long")
    row = sinks.cell_files(cells).first()
    assert row.name == "0000000005.cell" and binary.parse_cell(bytes(row.content))["offset"].tolist() == [-1, 1]
    (tmp_path / "c.json").write_text('{"x": {"1": {"y": 2, "z": 0}, "0": {"y": 9}, "k": {"y": 1}}}')
    assert [tuple(r) for r in counts_json.read_count_mirror(spark, f"{tmp_path}/c.json").collect()] == [("x", 1, "y", 2)]


def test_edits(spark):
    docs = spark.createDataFrame([(1, "one\ntwo\n\n \nthree"), (2, None), (3, "\n\nx")], "doc_id long, text string")
    got = sorted(map(tuple, edits.paragraph_lines(docs).collect()))
    assert got == [(1, 0, 1, 2), (1, 1, 5, 5), (3, 0, 3, 3)]
    row = edits.edit_mentions(spark.createDataFrame([("Cat cats cat-nap a b",)], "text string"), {"cat": "b", "b": None}).first()
    assert (row.text, row.n_edits) == ("b cats b-nap a ", 3)
    s = edits.centred("x " * 400 + "needle " + "y " * 400, ["needle"])
    assert "needle" in s and s.startswith("...") and s.endswith("...") and len(s) <= 526


def test_qa(spark):
    mc = qa.multiple_choice(spark.createDataFrame([("q?", ["A", "B"], ["x", "y"], "B"), ("r?", ["A", "B"], ["x", "y"], "0"), ("s?", ["A"], ["x"], "Z")], "question string, labels array<string>, texts array<string>, answer_key string"), "mc")
    wp = qa.word_problems(spark.createDataFrame([("n?", "because\n#### 7")], "question string, answer string"), "wp")
    assert [(r.question_text, r.answer_text, r.blocked_alternatives) for r in qa.together(mc, wp).collect()] == [("q?", "y", ["x"]), ("r?", "x", ["y"]), ("n?", "7", [])]


def test_gates_phrases_and_roles(spark):
    none = []
    c = spark.createDataFrame(
        [(1, "cat", None, None, "", None, "cats", "definition", ["a"]), (2, "cat", "thin", None, "", None, "cats", "definition", ["a"]), (3, "cat", None, False, "", None, "cats", "definition", ["a"]),
         (4, "the", None, True, "glue_as_content", None, "cats", "definition", ["a"]), (5, "cat", "supported", True, "", "anomalous", "cats", "definition", ["a"]),
         (6, "cat", None, None, None, None, "force on mass.", "open_educational_frame", ["force"]), (7, "cat", None, None, None, None, "force on mass.", "open_educational_frame", ["force", "mass"]), (8, "cat", None, None, None, None, "cats", "definition", none)],
        "k int, anchor string, health string, coherent boolean, rejected string, pattern_health string, subject string, frame_type string, context array<string>")
    out = questions.gated(c)
    assert [r.rule for r in out.orderBy("k").collect()] == ["R_ADMIT_SUPPORTED_CANDIDATE", "R_FACT_SUPPORT", "R_QUERY_FIELD", "R_PREVIOUS_REJECTION", "R_LOOKAHEAD_HEALTH", "R_FRAME_DOMAIN", "R_ADMIT_SUPPORTED_CANDIDATE", "R_FACT_SUPPORT"]
    assert reports.rejection_histogram(out).count() == 5
    q = spark.createDataFrame([(1, ["how", "laws", "of", "motion"]), (2, ["motion", "laws"])], "query_id int, anchors array<string>")
    p = spark.createDataFrame([("n", ["newton", "laws", "of", "motion"]), ("l", ["laws", "of", "motion"])], "phrase_id string, sequence array<string>")
    assert [tuple(r) for r in inference.match_phrase(q, p).collect()] == [(1, "l", 3)]
    assert spark.range(1).select(inference.role_fit(F.array(F.lit("action_candidate"), F.lit("object_candidate"), F.lit("object_candidate")))).first()[0] == 18


def test_visual(spark):
    a = spark.createDataFrame([("p", "c1", 0, 0, 10, 10), ("p", "c2", 9, 9, 20, 20), ("p", "c3", 20, 0, 30, 9), ("q", "c4", 0, 0, 200, 200)], "page_id string, component_id string, x1 int, y1 int, x2 int, y2 int")
    assert [tuple(r) for r in visual.overlaps(a, 8).collect()] == [("p", "c1", "c2")]
    g = spark.createDataFrame([(["...", ".#.", ".#."], "I", True)], "pattern array<string>, display string, approved boolean")
    c = spark.createDataFrame([(["#", "#"],), (["##"],), (["."],)], "pattern array<string>")
    assert [r.display for r in visual.recognise(c, g).orderBy(F.desc("display")).collect()][0] == "I"
    t = spark.createDataFrame([("p", 0, 0, 5, "a"), ("p", 0, 6, 9, "b"), ("p", 0, 30, 35, "c")], "page_id string, line int, x1 int, x2 int, display string")
    assert visual.reading_text(t).first().text == "ab c"


def test_reports_and_answers(spark):
    files = spark.createDataFrame([("a.TXT", "plain-text", "", 3), ("b.txt", "plain-text", "bad", 4)], "source_name string, converter string, warning string, size long")
    assert tuple(reports.intake_audit(files).first()) == (".txt", "plain-text", 2, 1, 7)
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "source_id int")
    assert tuple(reports.readiness(one(1, 2, 3), one(1, 2), one(1)).first()) == (3, 2, 1, 2)
    rules = reports.frame_rules(spark.createDataFrame([("how", "sear meat"), ("how", "sear fish")], "key string, text string")).first()
    assert rules.rows == 2 and rules.terms[0].w == "sear" and rules.examples == ["sear fish", "sear meat"]
    docs = spark.createDataFrame([(1, "Question: how to sear meat? Answer: use a hot pan."), (2, "gardens are green and calm")], "doc_id long, text string")
    passages, facts, walk = document_answer(docs, ["sear", "meat"], 2)
    assert passages.count() == 1 and facts.first().fact == "use a hot pan." and walk.answer
