import random

import numpy as np
from pyspark.sql import functions as F

import tessera.llm.toxicity as m


def corpus(seed=0, n=900):
    r = random.Random(seed)
    vocab = [f"w{i}q" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(vocab, k=r.randint(5, 200))
        toxic, junk = r.random() < 0.2, r.random() < 0.2
        for _ in range(r.randint(2, 6) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["Idiot", "scum,", "moronic", "moronish"]))
        docs.append((i, ("%%% " if junk else " ").join(w)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    seen = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    chain = m.fit_chain(d, seen, m.default_categories())
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1  # the earlier category's probability
    got = {r.doc_id: r for r in m.score_chain(d, chain, "toxic").collect()}
    rest = labels[600:]
    assert np.mean([got[i].toxic == bool(t) for i, _, t in rest]) > 0.95
    assert np.mean([(got[i].p_low_quality >= 0.5) == (q == 0) for i, q, _ in rest]) > 0.95
    kept = {r.doc_id for r in m.drop_toxic(d, seen).collect()}
    assert kept == {i for i, r in got.items() if not r.toxic}


def test_score_equals_plain_probabilities(spark):
    docs, labels = corpus(1, 300)
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "scum " * 30000)], "doc_id long, text string")
    chain = m.fit_chain(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), m.default_categories())
    rows = d.select(F.array(F.lit(0.0)).alias("y"), "text").mapInArrow(m._collectable, "y array<double>, w binary, c binary, low binary, dense binary").collect()
    x = chain.base([(np.frombuffer(r.w, np.uint64), np.frombuffer(r.c, np.int32)) for r in rows], np.stack([np.frombuffer(r.dense) for r in rows]))
    got = [(r.p_low_quality, r.p_toxic) for r in m.score_chain(d, chain, "toxic").collect()]
    assert np.allclose(got, chain.probabilities(x))


def test_bound_nulls_and_columns(spark):
    docs, labels = corpus(2, 120)
    d = spark.createDataFrame([(i, t, "x", None) for i, t in docs] + [(None, None, "y", 1)], "doc_id long, text string, y string, toxic int")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1), (7777, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    chain = m.fit_chain(d, lab, m.default_categories(), max_labelled=50)
    out = m.score_chain(d, chain, "toxic")
    assert out.columns == ["doc_id", "text", "y", "p_low_quality", "p_toxic", "toxic"] and out.count() == 121
    none = m.fit_chain(d, lab.limit(0), m.default_categories())
    assert {r.p_toxic for r in m.score_chain(d, none, "toxic").collect()} == {0.5}
    assert m.score_chain(d.limit(0), chain, "toxic").count() == 0
    assert m.best_cutoff(np.array([0.1, 0.2, 0.3, 0.9]), np.array([0, 0, 1, 1.0])) == 0.3


def test_folds_choose_their_own_words():
    """What is chosen on some rows doesn't depend on the others, whatever their labels and words."""
    r = np.random.default_rng(3)
    words_of = [(np.unique(r.integers(0, 60, 12).astype(np.uint64)), None) for _ in range(400)]
    y = np.array([[float(3 in w), float(7 in w)] for w, _ in words_of])
    words_of = [(w, np.ones(len(w), np.int32)) for w, _ in words_of]
    dense = r.normal(size=(400, 6))
    learn = np.arange(400) % 5 != 2
    first = m._described(words_of, dense, y, learn, 600)
    other = [(w, c) if ok else (np.array([59], np.uint64), np.ones(1, np.int32)) for (w, c), ok in zip(words_of, learn, strict=True)]
    second = m._described(other, np.where(learn[:, None], dense, 99.0), np.where(learn[:, None], y, 1.0), learn, 600)
    assert first[0].tolist() == second[0].tolist() and {3, 7} <= set(first[0].tolist())
    assert np.array_equal(first[1], second[1]) and np.array_equal(first[2], second[2])
    assert len(m._described(words_of, dense, y, learn, 1)[0]) == 1


def test_repeated_ids_and_labels(spark):
    docs, labels = corpus(4, 200)
    d = spark.createDataFrame([*docs, *[(5, "other text")] * 300], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, *[(i, q, 1 - t) for i, q, t in labels[:3]]], "doc_id long, quality int, toxic int")
    one = m.fit_chain(d, lab, m.default_categories())
    two = m.fit_chain(d.repartition(5), lab.orderBy(F.desc("doc_id"), "toxic"), m.default_categories())
    assert all(np.allclose(a, b) for a, b in zip(one.weights, two.weights, strict=True))
