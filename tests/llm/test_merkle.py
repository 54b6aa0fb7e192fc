import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import tessera.llm.places as places
from tessera.llm.merkle import digest, fold, manifest
from tessera.llm.places import placed
from tessera.llm.queries import manifest_of_documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    """Root and, for each leaf, [(place, other digests)] from the leaf up, by building whole levels."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i - i % 3 : i - i % 3 + 3]
            paths[k].append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
            at[k] = i // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def up(d, path):
    for place, others in path:
        d = h(*others[:place], d, *others[place:])
    return d


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        made[s] = own, tree([leaf_of(*r) for r in own])
    root, over = tree([made[s][1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        own, (sub, paths) = made[s]
        for r, p in zip(own, paths, strict=True):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            bad = (*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])
            folded = up(leaf_of(*bad), p + over[k])
            out.append((r[0], leaf_of(*r), sub, root, h(*[d for _, o in p + over[k] for d in o]), folded, folded == root))
    return sorted(out, key=repr)


def corpus(seed, sizes):
    r = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        for i in r.sample(range(100_000), n):
            rows.append((i, s, r.choice(["en", None]), r.choice([3, None]), r.choice(["é\nb", "", None, "a", "x" * 500 + "\n"])))
    r.shuffle(rows)
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("sizes", "rows"), [
    ({"a": 1}, 1 << 16), ({None: 1, "": 2, "a": 3, "ä": 4, "b": 28, "hot": 400}, 1 << 16), ({"hot": 700, "b": 82, None: 9}, 10), ({f"s{i}": 1 + i % 3 for i in range(40)}, 10),
])
def test_against_whole_levels(spark, monkeypatch, sizes, rows):
    monkeypatch.setattr(places, "PART_ROWS", rows)  # groups of many runs, several rounds
    data = corpus(len(sizes), sizes)
    got = sorted((tuple(r) for r in manifest_of_documents(spark.createDataFrame(data, SCHEMA)).collect()), key=repr)
    assert got == brute(data)


def test_edge_rows(spark):
    data = [(None, None, None, None, None), (None, "a", "x", 1, "y\n"), (7, "a", "x", 1, "t\nu"), (7, "a", "x", 1, "t\nu"), (7, "a", "x", 1, "w"), (8, "a", "x", 1, "")]
    docs = spark.createDataFrame(data, SCHEMA).withColumns({"leaf": F.lit(1), "path": F.lit("clash"), "grp": F.lit(2)})
    assert sorted((tuple(r) for r in manifest_of_documents(docs).collect()), key=repr) == brute(data)
    assert manifest_of_documents(docs.limit(0)).count() == 0


def test_other_arity_and_proofs(spark):
    leaves = spark.range(50).select(F.col("id").alias("k"), F.lit("g").alias("g"), digest(F.col("id")).alias("leaf"))
    got = manifest(leaves, "g", "k", arity=2).withColumn("again", fold(F.col("leaf"), F.col("path"))).withColumn("wrong", fold(digest(F.col("k") + 1), F.col("path"))).collect()
    assert len(got) == 50 and all(r.again == r.root == r.subroot != r.wrong and len(r.path) == 6 for r in got)
    with pytest.raises(ValueError, match="arity"):
        manifest(leaves, "g", "k", arity=10)


def test_places_and_sums(spark, monkeypatch):
    monkeypatch.setattr(places, "PART_ROWS", 7)
    r = random.Random(3)
    rows = [(r.choice("abb"), r.randrange(5), r.randrange(9)) for _ in range(200)]
    got = placed(spark.createDataFrame(rows, "g string, o int, v int").coalesce(1), "g", ["o"], ("v",)).collect()
    for g in "ab":
        own = sorted((x for x in got if x.g == g), key=lambda x: x.idx)
        assert [x.idx for x in own] == list(range(len(own))) and [x.o for x in own] == sorted(x.o for x in own)
        assert [x.before_v for x in own] == [sum(y.v for y in own[:i]) for i in range(len(own))]
        assert {(x.n, x.total_v) for x in own} == {(len(own), sum(x.v for x in own))}
    assert len({x.part for x in got}) > 3
