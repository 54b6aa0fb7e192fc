import hashlib
import random

import numpy as np
import pytest

from tessera.llm.pieces import decode_documents, default_model, digests, encode_documents, vocabulary


@pytest.fixture(scope="module")
def vocab():
    with open(default_model(), "rb") as f:
        return vocabulary(f.read())


def texts(seed=0, n=400):
    r = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "\r\n", "▁", "\x00", "the", "The", "ing", "ation", "été", "ñ", "日本", "\U0001f600", "<s>", "</s>", "<0x41>", "a", "b", "zz", "1", "23", " ", "　", "ﬁ", "é", "-", "===", "////"]
    return ["", " ", "▁", "\n", "x" * 3000, "ab" * 90 + " " * 50, *["".join(r.choices(bits, k=r.randint(1, 40))) for _ in range(n)]]


def test_equal_to_the_library(vocab):
    for t, ids in zip(texts(), vocab.encode(texts(), check=False), strict=True):
        assert ids.tolist() == vocab.library.encode(t), t
        assert vocab.decode(ids) == vocab.library.decode(ids.tolist()), t


def test_heap_and_rows_agree(vocab):
    words = sorted({w for t in texts(3) for w in vocab.chunks(t) if len(w) < 40})
    got = vocab.encode_chunks(words)
    assert all(vocab.by_heap(w) == got[w] for w in words)


def test_decode_any_ids(vocab):
    r = np.random.default_rng(0)
    for _ in range(300):
        ids = r.choice([0, 1, 2, *range(3, 259), 28705, *r.integers(259, 32000, 100)], r.integers(0, 12))
        assert vocab.decode(ids) == vocab.library.decode(ids.tolist()), ids


def test_columns(spark, vocab):
    docs = spark.createDataFrame([(1, None, 5, "q"), (1, " a  b", 6, None), (None, "été\n", 7, "z")], "doc_id long, text string, ids int, extra string")
    enc = encode_documents(docs, decoded_col="decoded")
    assert enc.columns == ["doc_id", "text", "extra", "ids", "decoded"]
    rows = {r.text: r for r in enc.collect()}
    assert rows[None].ids == [] and rows[None].decoded == "" and rows[" a  b"].decoded == " a  b" and rows["été\n"].ids == vocab.library.encode("été\n")
    assert {r.text: r.again for r in decode_documents(enc, text_col="again").collect()} == {None: "", " a  b": " a  b", "été\n": "été\n"}
    d = {r.n_tokens: r for r in digests(enc).collect()}
    ids = vocab.library.encode(" a  b")
    assert d[len(ids)].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and d[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert encode_documents(docs.limit(0)).count() == 0
