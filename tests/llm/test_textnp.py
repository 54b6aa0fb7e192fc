import numpy as np

from tessera.llm.textnp import FIRST_TABLE, PIECE, SECOND_TABLE, span_hashes


def hashes(spans, table=FIRST_TABLE):
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    return span_hashes(data, np.concatenate(([0], ends[:-1])), ends, table)


def thue_morse(n):
    s = b"a"
    for _ in range(n):
        s += s.translate(bytes.maketrans(b"ab", b"ba"))
    return s, s.translate(bytes.maketrans(b"ab", b"ba"))


def test_equal_spans_only():
    spans = [*thue_morse(10), *thue_morse(13), b"a", b"b", b"ab", b"ba", b"aa", b"x" * PIECE, b"x" * (PIECE + 1), b"x" * (3 * PIECE), b"y" + b"x" * PIECE, b"x" * PIECE + b"y"]
    for table in (FIRST_TABLE, SECOND_TABLE):
        assert len(set(hashes(spans, table).tolist())) == len(spans)
    assert not set(hashes(spans).tolist()) & set(hashes(spans, SECOND_TABLE).tolist())


def test_a_hash_depends_on_the_bytes_alone():
    spans = [b"abc", thue_morse(11)[0], b"abc", b"q" * (1 << 20), b"abc", thue_morse(11)[0], b"q" * (1 << 20)]
    h = hashes(spans)
    assert h[0] == h[2] == h[4] and h[1] == h[5] and h[3] == h[6]
    assert h[1] == hashes(spans[1:2])[0]


def test_swapped_pieces_differ():
    a, b = b"a" * PIECE, b"b" * PIECE
    assert len(set(hashes([a + b, b + a, a + a, b + b]).tolist())) == 4
