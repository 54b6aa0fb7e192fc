import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera.llm.impact as impact
from tessera.llm.impact import add_slices, best_places, search, slices_of, total_slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    tf = [Counter(terms(t)) for _, t in docs]
    held = [c for c in tf if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, _), c in zip(docs, tf, strict=True):
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Été", "naïve", "ÉTÉ", "日本", "a-b", "X9"]
    text = lambda most: " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=r.randint(0, most)))
    docs = [(i * 3, text(60)) for i in range(n)]
    docs += [(5_000 + i, "same text w1 w2") for i in range(70)] + [(None, "w1 w70"), (None, None), (9, "w3"), (9, "w3"), (8_000, ""), (8_001, " .,-"), (8_002, "w5 " * 30_000)]
    return docs, [(i, text(12)) for i in range(25)] + [(None, "w1 same"), (3, "w1"), (3, "W1 w1"), (99, None), (98, "nowhere"), (97, "...")]


@pytest.mark.parametrize(("k", "block", "ask"), [(50, 1 << 13, 1 << 20), (7, 64, 150)])
def test_against_brute_force(spark, monkeypatch, k, block, ask):
    monkeypatch.setattr(impact, "BLOCK_ITEM_BYTES", ask)  # in the second case several blocks of items
    docs, items = corpus(k, 300)
    got = search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items, k)


def test_small_blocks_and_cache(monkeypatch):
    monkeypatch.setattr(impact, "CACHE_BYTES", 1)
    s = impact._Search([(0, np.array([0, 1])), (1, np.array([1]))], np.array([3, 5]), 4, 9, 2)
    for lo in (4, 0):
        s.block(np.array([lo + 1, lo]), np.array([2, 1]), np.array([2, 1]), np.array([0, 1, 1]), np.array([1, 1, 1]))
    assert s.best[1][0].tolist() == [0, 4] and s.best[0][0].tolist() == [1, 5]


def test_slices_add_and_rank():
    r = np.random.default_rng(1)
    values = r.integers(1, 1 << 33, (7, 300)) * (r.random((7, 300)) < 0.4)
    parts = [slices_of(np.flatnonzero(v), v[v > 0], 300) for v in values]
    total = total_slices(parts)
    want = values.sum(axis=0)
    places, score = best_places(total, 1000)
    assert places.tolist() == np.flatnonzero(want).tolist() and score.tolist() == want[want > 0].tolist()
    places, score = best_places(total, 11)
    assert sorted(score.tolist()) == sorted(want.tolist())[-11:]
    equal = slices_of(np.arange(200), np.full(200, 6), 200)
    assert best_places(equal, 5)[0].tolist() == [0, 1, 2, 3, 4]
    assert add_slices(equal[None], equal[None])[0].shape == (4, 4)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumns({"item": F.lit(1), "n": F.lit("x"), "terms": F.lit(2)})
    items = spark.createDataFrame([(4, "B")], "item_id long, text string").withColumns({"doc_id": F.lit(1), "score": F.lit(2)})
    assert [tuple(r)[:3] for r in search(docs, items).collect()] == [(4, 1, 1)]
    assert search(docs.limit(0), items).count() == 0 and search(docs, items.limit(0)).count() == 0
