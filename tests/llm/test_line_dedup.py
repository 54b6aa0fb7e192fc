import random
from collections import Counter

import numpy as np

from tessera.llm.line_dedup import CuckooFilter, LineIndex, drop_repeated_lines


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip("\x20\x09\x0a\x0b\x0c\x0d"))


def brute(rows, min_docs):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= min_docs)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def corpus(seed, n=150):
    r = random.Random(seed)
    pool = ["Alle Rechte", " alle rechte\t", "É été", "é été", "", "  ", "x", *[f"line {i}" for i in range(60)]]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(1, 9)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "line 1\nLINE 1\n" * 2000), (n + 4, "a\r\nline 2\x0b")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_brute_force(spark):
    rows = corpus(1)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(frame(spark, rows)).collect()}
    assert got == brute(rows, 10)


def test_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb", 7, None), (1, "a\nb", 7, "q"), (None, "a", 8, "z")], "doc_id long, text string, n_lines int, block string")
    got = drop_repeated_lines(docs, min_docs=3)
    assert got.columns == ["doc_id", "text", "block", "n_lines", "n_dropped"]
    assert sorted((r.text, str(r.block), r.n_dropped) for r in got.collect()) == [("", "z", 1), ("b", "None", 1), ("b", "q", 1)]
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def test_insert_and_delete_undo_each_other(spark):
    rows, more = corpus(2), [(1000 + i, t) for i, t in corpus(3, 60)]
    index = LineIndex.build(frame(spark, rows))
    wide = index.insert(frame(spark, more))
    assert {r.doc_id: r.text for r in wide.apply(frame(spark, rows)).collect()} == {i: v[0] for i, v in brute(rows + more, 10).items() if i < 1000}
    back = wide.delete(frame(spark, more))
    assert {r.doc_id: r.text for r in back.apply(frame(spark, rows)).collect()} == {i: v[0] for i, v in brute(rows, 10).items()}
    assert {tuple(r) for r in back.refs.collect()} == {tuple(r) for r in index.refs.collect()}
    assert {(r.shard, r.held) for r in back.filters.where("held > 0").collect()} == {(r.shard, r.held) for r in index.filters.where("held > 0").collect()}


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 3000).astype(np.uint64)
    f = CuckooFilter.of(keys[:2000])
    assert f.holds(keys[:2000]).all() and f.holds(keys[2000:]).mean() < 0.01
    f.delete_all(keys[:1000])
    assert f.holds(keys[1000:2000]).all() and f.holds(keys[:1000]).mean() < 0.01
    assert CuckooFilter.from_bytes(f.to_bytes()).holds(keys[1000:2000]).all() and not CuckooFilter.sized(0).holds(keys).any()


def thue_morse(n):
    """A line of 2**n letters and its complement, whose polynomial hashes to a power of two are equal."""
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_regular_lines_are_told_apart(spark):
    one, other = thue_morse(11)
    rows = [(i, one if i % 2 else other) for i in range(10)]
    assert {r.n_dropped for r in drop_repeated_lines(frame(spark, rows)).collect()} == {0}
    assert {r.n_dropped for r in drop_repeated_lines(frame(spark, [(i, one) for i in range(10)])).collect()} == {1}


def test_repeated_ids_are_documents_of_their_own(spark):
    rows = [(1, "same\nother")] * 10
    got = drop_repeated_lines(frame(spark, rows)).collect()
    assert len(got) == 10 and {(r.text, r.n_lines, r.n_dropped) for r in got} == {("", 2, 2)}


def test_shards_grow_with_the_keys(spark, monkeypatch):
    import tessera.llm.line_dedup as m

    rows, more = corpus(4), [(1000 + i, f"new {i}\nline {i % 9}") for i in range(200)]
    index = LineIndex.build(frame(spark, rows))
    monkeypatch.setattr(m, "SHARD_KEYS", 5)
    wide = index.insert(frame(spark, more))
    assert index.shards == 16 and wide.shards >= 32
    assert {r.doc_id: r.text for r in wide.apply(frame(spark, rows + more)).collect()} == {i: v[0] for i, v in brute(rows + more, 10).items()}
