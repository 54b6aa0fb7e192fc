import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import tessera.llm.ppm as m


def tokens(text):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    return [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]


def brute(rows, order):
    trie, counts = m.ByteTrie(order), Counter()
    stream = lambda t: " ".join(tokens(t)).encode() + b"\n"
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            padded = b"\n" * order + stream(t)
            for j in range(order, len(padded)):
                trie.learn(padded[j - order : j], padded[j])
            counts.update([*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = [*tokens(t), None]
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), trie.score(stream(t)))
    return out


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocab = ["Der", "die", "ñandú", "the", "thing", "x", "été", "ÉTÉ", "日本", "a.b", *["".join(r.choices("abcde", k=r.randint(1, 9))) for _ in range(80)]]
    rows = [(i, r.choice([" ", "\n", "\t "]).join(r.choices(vocab, k=r.randint(1, 50)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "z" * 5000), (n + 4, "the THE  the\r\n")]


@pytest.mark.parametrize("order", [2, 5, 6])
def test_against_plain_trie(spark, monkeypatch, order):
    monkeypatch.setattr(m, "_SLICE", 700)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, order)
    want = brute(rows, order)
    for r in got.collect():
        assert tuple(r[1:5]) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9) and r.score == pytest.approx(want[r.doc_id][5], rel=1e-9)


def test_probabilities_sum_to_one():
    trie = m.ByteTrie(3)
    trie.score(b"abracadabra alakazam", learn=True)
    for context in (b"abr", b"aka", b"zzz", b"\xffab"):
        assert sum(10 ** trie.log10(context, s) for s in range(256)) == pytest.approx(1)


def test_edges_and_adaptive(spark):
    docs = spark.createDataFrame([(None, "a b", "x"), (1, None, None), (1, None, None)], "doc_id long, text string, block string")
    got = m.score_documents(docs, F.col("doc_id") == 1).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.train_tokens) for r in got) == [("1", True, 1, 3), ("1", True, 1, 3), ("None", False, 3, 3)]
    assert m.score_documents(docs.limit(0), F.lit(False)).count() == 0
    s = {r.doc_id: r.score for r in m.adaptive_scores(spark.createDataFrame([(1, "ab " * 50), (2, None)], "doc_id long, text string")).collect()}
    assert s[2] == pytest.approx(-math.log10(256)) and -60 < s[1] < -5
