import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tessera.llm.places as places
from tessera.llm.chat import CONTROLS, Template, _codec, assembled, conversation_digests, format_conversations, read_back
from tessera.llm.pieces import default_model

SCHEMA = "conv_id long, turn long, role string, text string"


def codec():
    with open(default_model(), "rb") as f:
        return _codec(f.read())


def corpus(seed):
    r = random.Random(seed)
    bits = [*CONTROLS, "<", "[", "\\", "\\\\", "<\\s>", "[\\\\INST]", "▁", " ", "\n", "é", "😀", "ok", "s>", "/INST]", "\x00", "<<s>", "<|", "|>", "​"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "<s>▁", "a\nb"]), r.choice([None, "".join(r.choices(bits, k=r.randint(0, 9)))])) for c in range(40) for t in range(r.randint(1, 7))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)] + [(None, 1, "user", "x"), (None, None, "assistant", "y"), (7, 3, "user", "again"), (7, 3, "user", "again"), (100, 0, "assistant", "long [INST] " * 9000)]
    r.shuffle(rows)
    return rows


def brute(rows):
    out = {}
    e = lambda t, cs=CONTROLS: sum(t.count(c[0] + "\\" * k + c[1:]) for c in cs for k in range(12))
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    for c, own in convs.items():
        own = sorted(own)
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        h = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(own), h(said), len(loss), h(loss), 7 + sum(23 + len(r) + len(t) + e(r) + e(t) for _, _, r, t in own))
    return out


@pytest.mark.parametrize("rows", [1 << 16, 25])
def test_read_back_against_the_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(places, "PART_ROWS", rows)  # a conversation over many ranges
    data = corpus(5)
    made = format_conversations(spark.createDataFrame(data, SCHEMA).withColumns({"ids": F.lit(1), "idx": F.lit(2), "n": F.lit(3)})).cache()
    got = {r[0]: tuple(r)[1:] for r in conversation_digests(read_back(made)).collect()}
    want = brute(data)
    tied = {c for c in want if len([1 for x in data if x[0] == c]) != len({x[1] for x in data if x[0] == c})}
    assert got.keys() == want.keys() and {c: v for c, v in got.items() if c not in tied} == {c: v for c, v in want.items() if c not in tied}
    assert got[7][0] == want[7][0] and got[7][2] == want[7][2]
    c = codec()
    for conv in (0, 99, 100, None):
        own = sorted((r for r in made.collect() if r.conv_id == conv), key=lambda r: r.place)
        ids = [i for r in own for i in r.ids]
        assert ids[0] == c.first and ids[-1] == c.last and ids.count(c.turn) == len(own) == own[0].n_turns and len(ids) == own[0].n_tokens
        assert [r.token_start for r in own] == [sum(len(x.ids) for x in own[:k]) for k in range(len(own))]
        assert [r.loss_start for r in own] == [sum(sum(x.mask) for x in own[:k]) for k in range(len(own))]
        for r in own:
            shown = r.formatted.removeprefix("<s>").removesuffix("</s>")
            role, text = shown.removeprefix("<|turn|>").removesuffix("<|end|>").split("<|text|>")
            inner = [np.array(x, np.int32) for x in (r.ids[r.ids.index(c.turn) + 1 : r.ids.index(c.text)], r.ids[r.ids.index(c.text) + 1 : r.ids.index(c.end)])]
            assert c.decode(inner) == [role, text] and not any(x in role + text for x in CONTROLS)
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0 and conversation_digests(read_back(made.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("▁ \n\\<[")), max_size=40), max_size=5))
def test_texts_come_back(texts):
    c = codec()
    assert c.decode(c.encode(texts)) == texts


def test_mask_by_prefix_sums():
    ids, mask, size = assembled([np.array(x, np.int32) for x in ([9], [1, 2], [], [3], [4, 5])], np.array([False, True, True, False, True]), np.array([0, 0, 1, 1, 1]))
    assert ids.tolist() == [9, 1, 2, 3, 4, 5] and mask.tolist() == [False, True, True, False, True, True] and size.tolist() == [3, 3]


def test_templates():
    with pytest.raises(ValueError, match="meet"):
        Template(controls=(*CONTROLS, "s><"))
    with pytest.raises(ValueError, match="own"):
        Template(controls=("<s>",))
