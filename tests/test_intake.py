"""Intake, chat exports, workbooks and the mending of encodings on small inputs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import curation, lexicon, phrases, relations, search
from tessera.plans import intake
from tessera.sources import chats, documents


@pytest.fixture(scope="module")
def lex(spark):
    return spark.createDataFrame([("cat", 1), ("sat", 2)], "anchor string, symbol long")


def test_tables_of_an_intake(spark, lex, tmp_path):
    docs = spark.createDataFrame([(1, "The cat sat.\n\nThe cat"), (2, None), (3, "")], "doc_id long, text string")
    intake.save(intake.build(docs, lex), str(tmp_path))
    got = intake.load(spark, str(tmp_path))
    assert [tuple(r) for r in got.blocks.orderBy("paragraph_id").collect()] == [(1, 0, 4), (1, 1, 2)]
    assert {r.anchor: r.known for r in got.occurrences.collect()} == {"the": False, "cat": True, "sat": True, ".": False}
    assert sorted(tuple(r) for r in got.cells.collect()) == [("0x0000000001", 1, "0x0000000002", 1), ("0x0000000002", -1, "0x0000000001", 1)]
    assert {r.anchor: r.observations for r in got.missing.collect()} == {"the": 2, ".": 1}
    assert tuple(intake.verify(got).first()) == (1, 6, True, True)
    assert intake.build(docs, lex, ["the", "."]).relations.count() == 2
    empty = intake.build(docs.limit(0), lex)
    assert tuple(intake.verify(empty).first()) == (0, 0, True, True)


def test_a_folder_in_rounds(spark, lex, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.txt").write_text(f"cat {i}")
    intake.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), lex, files_at_a_time=2)
    rounds = sorted(p.name for p in (tmp_path / "out").glob("round-*"))
    assert rounds == ["round-0", "round-1", "round-2"]
    assert sum(intake.load(spark, str(tmp_path / "out" / r)).occurrences.count() for r in rounds) == 10


def test_chat_exports(spark):
    listed = [{"title": "A", "messages": [{"role": "user", "content": "late", "timestamp": 5}, {"sender": "bot", "text": "early", "time": 1}, {"role": "user", "content": " "}, {"role": "user", "content": "whenever"}]}]
    tree = {"title": "B", "mapping": {"x": {"message": {"author": {"role": "user"}, "content": {"parts": ["a", "b"]}, "create_time": 2}}, "root": {"message": None}}}
    files = spark.createDataFrame([("l", json.dumps(listed)), ("t", json.dumps(tree)), ("bad", "{oops"), ("none", None), ("m", json.dumps({"memories": [{"text": "tea"}, {"content": "milk"}, {"text": ""}]}))], "source_name string, content string")
    got = sorted(tuple(r)[:6] for r in chats.turns(files).collect())
    assert got == [("l", 1, "A", 1, "bot", "early"), ("l", 1, "A", 2, "user", "late"), ("l", 1, "A", 3, "user", "whenever"), ("t", 1, "B", 1, "user", "a\nb")]
    assert [r.text for r in chats.memories(files).orderBy("at").collect()] == ["tea", "milk"]


def test_workbook_and_repair():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Name</t></si><si><r><t>To</t></r><r><t>m</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", '<w><sheetData><row><c t="s"><v>1</v></c><c><v>3.5</v></c></row><row><c/></row></sheetData></w>')
        z.writestr("xl/worksheets/sheet1.xml", '<w><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>N</t></is></c></row></sheetData></w>')
    assert documents.convert("a.xlsx", out.getvalue())["text"] == "Name | N\nTom | 3.5"
    for good in ("don’t", "“ä”", "naïve – café …", "日本", "é"):
        once = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in good.encode() if b > 127) if not good.isascii() else good
        assert documents.repair(once) == "".join(c for c in good if ord(c) > 127)
    assert documents.repair("plain ﬁne é") == "plain fine é"


def test_long_spans_equal_those_of_arrays(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a x b y y c", "a b", "c b a c", "b " * 30 + "a c", "a a b c c b a"])], "doc_id long, text string")
    arrays = relations.paragraph_anchors(docs).select("source_id", search.proximity_span(F.col("anchors"), ["a", "b", "c"]).alias("s")).where("s is not null")
    rows = search.spans(relations.placed_anchors(docs), ["a", "b", "c"], ["source_id"])
    assert {r.source_id: r.s for r in arrays.collect()} == {r.source_id: r.span for r in rows.collect()}


def test_streams_and_sequences_in_pieces(spark):
    docs = spark.createDataFrame([(1, "the cat ! u12345678 sat of the cat"), (2, None), (3, "the of")], "doc_id long, text string")
    assert {r.source_id: r.stream for r in phrases.streams(docs).collect()} == {1: ["the", "cat", "u", *"12345678", "sat", "of", "the", "cat"], 2: [], 3: ["the", "of"]}
    rows = [("s", i, i % 5, 1, 0, i in (0, 7, 13), i == 3) for i in range(20)]
    stream = spark.createDataFrame(rows, "stream_id string, ordinal long, symbol long, lane long, flags long, starts boolean, blocked boolean")
    whole, cut = (sorted(tuple(r) for r in relations.sequence_relations(stream, piece=p).collect()) for p in (4096, 6))
    assert whole == cut and len(whole) > 20
    assert sum(r[-1] for r in whole) == 2 * sum(1 for i in range(20) for j in range(i + 1, min(20, i + 7)) if 3 not in (i, j) and not any(s in range(i + 1, j + 1) for s in (7, 13)))


def test_queue_moves_and_temporary_symbols(spark, lex, monkeypatch):
    queue = spark.createDataFrame([("dog", 3, "unmatched"), ("cow", 1, "pending")], "word string, frequency long, status string")
    asked = spark.createDataFrame([("dog",), ("hen",), ("cat",)], "word string")
    assert sorted(tuple(r) for r in curation.moved(queue, asked, "pending", lex).collect()) == [("cow", 1, "pending"), ("dog", 3, "pending"), ("hen", 0, "pending")]
    slots = spark.createDataFrame([(7, "available"), (8, "USED"), (9, "AVAILABLE")], "slot long, status string")
    assert [tuple(r) for r in curation.assigned_pending(queue, slots, lex.withColumnRenamed("anchor", "word")).collect()] == [("cow", 7)]
    monkeypatch.setattr(lexicon, "temp_symbol", lambda v, s, a, salt: F.when(salt < 2, F.lit("U0")).otherwise(F.concat(F.lit("U"), a)))
    got = {r.anchor: r.symbol for r in lexicon.temp_symbols(spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "source_id long, anchor string")).where("source_id = 1").collect()}
    assert got["a"] == "U0" and len(set(got.values())) == 3
