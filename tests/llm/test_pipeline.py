import random
import weakref

import corpus_pipeline
import pyarrow as pa
from test_decontaminate import brute as leaks
from test_line_dedup import brute as lines
from test_near_dedup import brute as groups

from tessera.llm import pieces
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.pieces import default_model, vocabulary
from tessera.llm.toxicity import Chain, default_categories, fit_chain, score_chain


def fixture(spark, folder):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(12, 30)))) for i in range(6)]
    base = ["\n".join(" ".join(r.choices(vocab, k=r.randint(5, 40))) for _ in range(4)) for _ in range(60)]
    rows, labels = [], []
    for i in range(240):
        t, toxic = r.choice(base), r.random() < 0.15
        w = t.split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        t = " ".join(w)
        if r.random() < 0.5:
            t += "\nCommon Footer "
        if r.random() < 0.1:
            t += "\n" + r.choice(items)[1]
        if toxic:
            t += " idiot scum idiot moron"
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [x[:2] for x in rows], items


def test_against_brute_force(spark, tmp_path):
    sf = str(tmp_path)
    rows, items = fixture(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chain = fit_chain(docs, spark.read.parquet(f"{sf}/labels.parquet"), default_categories())
    toxic = {x.doc_id for x in score_chain(docs, chain, "toxic").where("toxic").collect()}
    assert 5 < len(toxic) < 60
    now = {i: v[0] for i, v in lines([x for x in rows if x[0] not in toxic], 10).items()}
    group = groups(list(now.items()), 5, 80)
    now = {i: t for i, t in now.items() if group[i][1] == i}
    bad = {i for i, _ in leaks(list(now.items()), items)}
    assert bad
    with open(default_model(), "rb") as f:
        lib = vocabulary(f.read()).library
    want = {i: (lib.encode(t), t) for i, t in now.items() if i not in bad}
    got = {r.doc_id: (r.ids, r.decoded) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    sf = str(tmp_path)
    fixture(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_repeated_ids_in_the_near_copy_stage(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a, "en"), (5, b, "en"), (1, a + " x", "en"), (7, b + " z", "de"), (8, "own words of this one here", None), (8, "own words of this one here", None), (None, a, None), (9, None, None), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, a + " x"), (5, b), (8, rows[4][1]), (None, a), (9, None), (9, "")], key=repr)
    near = [(3, a), (3, a + " y"), (3, b)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(near, "doc_id long, text string"), "").collect()
    assert len(kept) == 2 and (3, b) in {tuple(r) for r in kept}


def test_workers_let_go_of_what_a_stage_kept(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 50), i -> concat('w', hash(id, i)))) as text")

    def held(batches):
        import os

        from tessera.llm import pieces, store

        for batch in batches:
            kept = len(getattr(store, "KEPT", {})) + len(getattr(pieces, "_LOADED", {}))
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows, pa.int64()), pa.array([kept] * batch.num_rows, pa.int64())], names=["pid", "kept"])

    look = lambda: {(r.pid, r.kept) for r in docs.mapInArrow(held, "pid long, kept long").distinct().collect()}
    pieces.encode_documents(docs).write.format("noop").mode("overwrite").save()
    before = look()
    assert {k for _, k in before} == {1}
    near_duplicates(docs).write.format("noop").mode("overwrite").save()
    after = look()
    assert {p for p, _ in after} == {p for p, _ in before} and {k for _, k in after} == {0}


def test_a_fit_lays_out_one_folds_features_at_a_time(spark, tmp_path, monkeypatch):
    fixture(spark, str(tmp_path))
    held, most, real = set(), [0], Chain.base

    def counted(self, *given):
        out = real(self, *given)
        held.add(id(out))
        most[0] = max(most[0], len(held))
        weakref.finalize(out, held.discard, id(out))
        return out

    monkeypatch.setattr(Chain, "base", counted)
    fit_chain(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), default_categories())
    assert 1 <= most[0] <= 2
