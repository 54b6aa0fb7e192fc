import random
import re

import pytest

from tessera.llm.near_dedup import near_duplicates


def brute(rows, k, percent):
    """Doc ids to (set size, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(12)]
    out = []
    for _ in range(n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    return list(enumerate([*out, None, "", " \t\n", "One", "one", "ONE two", "one two ", "x " * 40000], 7))


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, None), (5, 80, None), (3, 85, 2000)])
def test_against_all_pairs(spark, monkeypatch, k, percent, block):
    import tessera.llm.near_dedup as m

    if block:  # groups that don't fit are confirmed block by block
        monkeypatch.setattr(m, "GROUP_BYTES", block)
    rows = corpus(k)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d", 1, 2), (5, "a b c d", 1, 2), (5, "a b c d", 1, 2), (4, "A b  c d", 1, 2), (6, None, None, None)], "doc_id long, text string, n long, keys int")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [("4", 4, True), ("5", 4, False), ("5", 4, False), ("6", 6, True), ("None", None, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


LONG = " ".join(f"a{i}" for i in range(40))
OTHER = " ".join(f"b{i}" for i in range(40))


@pytest.mark.parametrize("flip", [False, True])
def test_repeated_ids_with_unlike_texts(spark, flip):
    """Each row goes by its own text: links of either text of an id hold, and an unlike text of a linked id stays."""
    def run(rows):
        docs = spark.createDataFrame(rows[::-1] if flip else rows, "doc_id long, text string")
        return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())

    assert run([(1, LONG), (1, OTHER), (2, LONG + " y"), (3, OTHER + " z")]) == [(1, 36, 1, True), (1, 36, 1, True), (2, 37, 1, False), (3, 37, 1, False)]
    assert run([(5, LONG), (5, OTHER), (1, LONG + " x")]) == [(1, 37, 1, True), (5, 36, 1, False), (5, 36, 5, True)]
    assert run([(9, LONG), (9, LONG), (9, OTHER), (4, LONG), (4, LONG)]) == [(4, 36, 4, True), (4, 36, 4, True), (9, 36, 4, False), (9, 36, 4, False), (9, 36, 9, True)]


def test_groups_are_sized_by_their_texts(spark, monkeypatch):
    import tessera.llm.near_dedup as m

    monkeypatch.setattr(m, "GROUP_BYTES", 4000)  # few shingles, long texts: the group is cut into blocks
    rows = [(i, "same word " * 2000 + f"end{i % 3}") for i in range(6)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 50).collect()
    assert {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]
