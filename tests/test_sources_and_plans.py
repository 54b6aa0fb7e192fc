import io
import struct
import zipfile

from pyspark.sql import functions as F

from tessera.operators import relations
from tessera.plans.walk import answer_walk, forward
from tessera.sources import binary as B
from tessera.sources import documents as D

ROWS = {"root": [1, 2**40 - 1], "neighbor": [3, 4], "offset": [-6, 2], "lane": [0, 255], "flags": [1, 2], "root_lane": [5, 0], "count": [7, 2**40]}
SYMS = {"symbol": [1, 2, 3], "lane": [0, 1, 0], "flags": [0, 0, 9], "starts": [True, False, True], "blocked": [False, True, False]}


def plain(d):
    return {k: [x.item() for x in v] for k, v in d.items()}


def test_binary_round_trips(spark, tmp_path):
    assert plain(B.parse_records(B.pack_records(ROWS))) == ROWS and len(B.pack_records(ROWS)) == 48
    assert {k: v for k, v in plain(B.parse_symbols(B.pack_symbols(SYMS))).items() if k != "ordinal"} == SYMS and len(B.pack_symbols(SYMS)) == 24
    meta, rel = B.parse_map(B.pack_map({"b": 1, "a": "é"}, ROWS))
    assert meta == {"a": "é", "b": 1} and plain(rel)["count"] == ROWS["count"]
    assert B.parse_side(B.pack_side(B.NULLS, [{"x": 1}]), B.NULLS) == [{"x": 1}]
    cell = B.parse_cell(B.pack_cell(77, ROWS, root_lane=1, generation=5))
    assert plain(cell)["root"] == [77, 77] and plain(cell)["offset"] == [-6, 2] and plain(cell)["generation"] == [5, 5]
    (tmp_path / "a.cell").write_bytes(B.pack_cell(9, ROWS))
    broken = bytearray(B.pack_cell(9, ROWS))
    broken[-1] ^= 1
    (tmp_path / "b.cell").write_bytes(bytes(broken))
    rows = B.read_binary(spark, str(tmp_path), "cell")
    assert sorted((r.root or 0, r.error or "") for r in rows.collect()) == [(0, "checksum of the rows"), (9, ""), (9, "")]
    assert tuple(B.verify(rows).first()) == (2, 1)


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_converters(spark, tmp_path):
    text = lambda name, raw: D.convert(name, raw)["text"]
    assert text("a.csv", b"x;y\n1; 2\n") == "x | y\n1 | 2"
    assert text("a.json", b'{"a": [1, {}], "b": "x  y"}') == "root.a.0 | int | 1\nroot.a.1 | object | empty\nroot.b | str | x y"
    assert text("a.xml", b"<r>one<i>two</i> three</r>") == "one\ntwo\nthree"
    lines, side = D.html_lines('<p>Hi <a href="/x">there</a><script>no</script></p><table><tr><td>1</td><td>b c</td></tr></table><img src="i.png">')
    assert lines == ["Hi there", "1 | b c"] and [(s["kind"], s["value"]) for s in side] == [("href", "/x"), ("image", "i.png")]
    assert text("a.docx", zipped({"word/document.xml": '<w:d xmlns:w="w"><w:p><w:t>A</w:t><w:t>b</w:t></w:p><w:p><w:t>C</w:t></w:p></w:d>'})) == "Ab\nC"
    assert text("a.pptx", zipped({f"ppt/slides/slide{i}.xml": f'<a:s xmlns:a="a"><a:p>s{i}</a:p></a:s>' for i in (10, 2)})) == "s2\ns10"
    epub = zipped({"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="1" href="b.html"/><item id="2" href="a.html"/><itemref idref="2"/><itemref idref="1"/></p>', "o/a.html": "<p>first</p>", "o/b.html": "<p>second</p>"})
    assert text("a.epub", epub) == "first\nsecond"
    assert text("a.eml", b"From: a@b.c\nSubject: S\nContent-Type: text/plain\n\nbody\n").endswith("Subject: S\nbody")
    assert text("a.zip", zipped({"b.txt": "B", "A.txt": "a", "x.exe": "no"})) == "[A.txt]\na\n[b.txt]\nB\n[x.exe]\nblocked"
    assert D.image_probe(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 4)) == ("PNG", 3, 4)
    assert D.convert("a.json", b"{oops")["converter"] == "plain-text-fallback" and D.decode("é".encode("utf-16")) == "é"
    assert text("a.rtf", rb"{\rtf1 Hello \b world}") == "Hello world"
    (tmp_path / "n.txt").write_text("plain")
    assert [(r.source_name, r.text, r.converter) for r in D.read_documents(spark, str(tmp_path)).collect()] == [("n.txt", "plain", "plain-text")]


def test_walk_finds_the_neighbours(spark):
    docs = spark.createDataFrame([(i, "sear the meat in a hot pan with smoke") for i in range(12)] + [(99, "garden flowers bloom")], "doc_id long, text string")
    rel = relations.corpus_relations(docs)
    walk = answer_walk(rel, ["how", "sear", "meat"], steps=3)
    assert walk.answer and set(walk.answer) <= {"hot", "pan", "smoke"} and len(set(walk.answer)) == len(walk.answer)
    assert answer_walk(rel.where(F.lit(False)), ["sear"]).answer == []


def test_forward_cloud_is_what_follows(spark):
    docs = spark.createDataFrame([(i, "sear the meat in a hot pan with smoke") for i in range(12)], "doc_id long, text string")
    rel = relations.corpus_relations(docs)
    assert [(r.neighbor, r.n) for r in forward(rel, ["pan"]).collect()] == [("smoke", 12), ("with", 12)]
