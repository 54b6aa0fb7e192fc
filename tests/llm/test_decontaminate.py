import random
import re
from collections import Counter

import tessera.llm.decontaminate as m


def tokens(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")) if x]


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)])


def brute(docs, items, k=5, least=0.8):
    out = {}
    for d, t in docs:
        w = tokens(t)
        for i, it in items:
            v = tokens(it)
            if not v or not w:
                continue
            want, size = grams(v, min(k, len(v))), min(k, len(v))
            if len(w) < size:
                continue
            best = 0
            for s in range(max(1, len(w) - len(v) + 1)):
                have = grams(w[s : s + len(v)], size)
                both = sum((have & want).values())
                best = max(best, both / (sum(have.values()) + sum(want.values()) - both))
            if best >= least:
                out[d, i] = best
    return out


def corpus(seed=0):
    r = random.Random(seed)
    vocab = [f"W{i}" for i in range(50)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 2, 4, 5, 6, 15, 15, 30, 59])))) for i in range(25)] + [(90, None), (91, ""), (92, "the the the the the the the the")]
    docs = []
    for d in range(160):
        w = [f"x{r.randrange(400)}" for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            p = (r.choice(items)[1] or "").lower().split()
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                if p:
                    r.choice([lambda: p.pop(r.randrange(len(p))), lambda: p.insert(r.randrange(len(p)), "zz"), lambda: p.__setitem__(r.randrange(len(p)), "yy")])()
            at = r.randint(0, len(w))
            w[at:at] = p
        docs.append((d, r.choice([" ", "\n"]).join(w)))
    return [*docs, (900, None), (901, " \n"), (902, "the " * 5000)], items


def test_against_brute_force(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in m.contaminated(d, b).collect()}
    assert got == want and len(want) > 100
    assert {r.doc_id for r in m.decontaminate(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_blocks_of_items_and_columns(spark, monkeypatch):
    docs, items = corpus(1)
    monkeypatch.setattr(m, "ITEM_BYTES", 600)
    d = spark.createDataFrame([(i, t, None, i) for i, t in docs[:50]] + [(None, items[8][1], "a", 1)], "doc_id long, text string, similarity string, item_id long")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in m.contaminated(d, b).collect()}
    assert got - {x for x in got if x[0] is None} == set(brute(docs[:50], items)) and any(x[0] is None for x in got)
    assert m.decontaminate(d, b).columns == d.columns
    assert m.contaminated(d.limit(0), b).count() == 0 and m.decontaminate(d, b.limit(0)).count() == 51
