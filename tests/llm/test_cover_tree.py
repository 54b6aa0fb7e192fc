import numpy as np
import pytest

import tessera.llm.cover_tree as m


def brute(rows, least):
    unit = lambda v: np.array(v, float) / np.abs(v).max()
    good = [(i, k, unit(v)) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, comp = {}, {i: i for i, _ in rows}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, k, x in good:
        for j, q, y in good:
            if k != q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[k] = links.get(k, 0) + 1
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return sorted((str(i), links.get(k, 0), None if i is None else find(i)) for k, (i, _) in enumerate(rows))


def corpus(seed, n=300, dim=8):
    r = np.random.default_rng(seed)
    base = r.normal(size=(25, dim))
    x = base[r.integers(0, 25, n)] + r.normal(size=(n, dim)) * r.choice([0.0, 0.1, 0.25, 0.5], n)[:, None]
    rows = [(i + 5, v) for i, v in enumerate((x * r.choice([1, 3], n)[:, None]).tolist())]
    return [*rows, (900, None), (901, []), (902, [0.0] * dim), (903, [float("nan")] + [1.0] * (dim - 1)), (904, [None] + [1.0] * (dim - 1)), (905, [1.0, 2.0]), (906, [1.0, 2.0]), (907, [float("inf")] * dim), (None, rows[0][1]), (5, rows[0][1]), (908, [1e-200] * dim)]


@pytest.mark.parametrize(("block", "cell"), [(3000, 6000), (40, 30)])
def test_against_all_pairs(spark, monkeypatch, block, cell):
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "CELL_ROWS", cell)
    rows = corpus(block)
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, links long")
    got = m.near_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == brute(rows, 0.9)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_empty(spark):
    assert m.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tree_is_nested_and_covers():
    r = np.random.default_rng(1)
    x = m._unit(np.repeat(r.normal(size=(40, 5)), 10, axis=0) + r.normal(size=(400, 5)) * 0.05)
    tree = m.CoverTree(x)
    for (upper, far, _), (lower, _, parent) in zip(tree.levels, tree.levels[1:], strict=False):
        assert set(upper) <= set(lower)
        assert (np.linalg.norm(x[lower] - x[upper[parent]], axis=1) <= far[parent] + 1e-3).all()
    assert (m.linked(tree, x, tree, x, 0.9) == (x @ x.T >= 0.9)).all()
