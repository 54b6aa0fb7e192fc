"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose joint piece is in the vocabulary and takes the pair of highest
score (of equals the leftmost) until none is left; symbols outside the vocabulary become byte pieces. A chunk (white space
marks and what follows them up to the next) can be encoded by itself where no piece has a mark after another character,
which is checked when a vocabulary is loaded. Short chunks run their agendas side by side in numpy, one row each; long
ones use a heap. In every Arrow batch the sentencepiece library must agree on the ids of each chunk that is encoded anew, and
on the batch's first text as a whole in both directions; chunks met before come from a bounded cache. What each id decodes
to, after another and first, is compared when a vocabulary is loaded.

Decoding puts piece surfaces and bytes together from the ids alone.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.store import KEPT, lean, small_batches, trim

MARK = "▁"
CACHE = 150_000
_SHORT = 40

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """A BPE vocabulary with byte fallback, a dummy prefix and no other normalisation, from a model file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        kind = [0 if lib.is_control(i) else 1 if lib.is_unknown(i) else 2 if lib.is_byte(i) else 3 for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces aren't supported")
        self.bytes_at = {int(names[i][3:5], 16): i for i in range(n) if kind[i] == 2}
        if len(self.bytes_at) != 256 or lib.encode("  ") != lib.encode(MARK * 2) or lib.encode("½") == lib.encode("1/2"):
            raise ValueError("byte fallback and an identity normaliser are needed")
        ids = {names[i]: i for i in range(n) if kind[i] == 3}
        self.symbols = dict(ids)
        for p in ids:
            for c in p:
                self.symbols.setdefault(c, len(names) + len(self.symbols))
        self.base = n
        self.stride = max(self.symbols.values()) + 1
        merges = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    merges[a * self.stride + b] = i
        self.merges = merges
        self.pairs = np.array(sorted(merges), np.int64)
        self.joint = np.array([merges[k] for k in self.pairs.tolist()], np.int64)
        self.score = np.array([lib.get_score(i) for i in range(n)], np.float64)
        if any("\n" in p for p in ids if len(p) > 1):
            raise ValueError("a piece with a line end inside is not supported")
        self.apart = all(MARK not in p.lstrip(MARK) for p in ids)
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        surface = [b"" if k == 0 else b" \xe2\x81\x87 " if k == 1 else bytes([int(names[i][3:5], 16)]) if k == 2 else names[i].replace(MARK, " ").encode() for i, k in enumerate(kind)]
        self.length = np.array([len(s) for s in surface], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.marked = np.array([kind[i] == 3 and names[i].startswith(MARK) for i in range(n)])
        self.silent = np.array([k == 0 for k in kind])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.cut.findall(marked) if self.apart else [marked]

    def _ids(self, symbols, text: str, spans) -> bytes:
        out: list[int] = []
        for s, (a, b) in zip(symbols, spans, strict=True):
            if 0 <= s < self.base:
                out.append(s)
            else:
                out.extend(self.bytes_at[x] for x in text[a:b].encode("utf-8", "surrogatepass"))
        return np.array(out, np.int32).tobytes()

    def by_heap(self, chunk: str) -> bytes:
        """One chunk, by a priority queue of pairs over a linked list of symbols."""
        sym = [self.symbols.get(c, -1) for c in chunk]
        n = len(sym)
        nxt, prv, end = [*range(1, n), -1], [-1, *range(n - 1)], list(range(1, n + 1))
        agenda: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0:
                m = self.merges.get(sym[i] * self.stride + sym[j])
                if m is not None:
                    heapq.heappush(agenda, (-self.score[m], i, sym[i], sym[j], m))

        for i in range(n):
            offer(i)
        gone = [False] * n
        while agenda:
            _, i, a, b, m = heapq.heappop(agenda)
            j = nxt[i]
            if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], end[i], nxt[i], gone[j] = m, end[j], nxt[j], True
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        keep = [i for i in range(n) if not gone[i]]
        return self._ids([sym[i] for i in keep], chunk, [(i, end[i]) for i in keep])

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.stride + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        ok = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        joint = np.where(ok, self.joint[at], -1)
        return joint, np.where(ok, self.score[joint], -np.inf)

    def side_by_side(self, chunks: list[str]) -> list[bytes]:
        """Chunks of one length, each row an agenda: every round each row takes its best pair."""
        n, width = len(chunks), len(chunks[0])
        get = self.symbols.get
        sym = np.array([[get(c, -1) for c in x] for x in chunks], np.int64).reshape(n, width)
        size = np.ones((n, width), np.int64)
        many = np.full(n, width)
        out_sym, out_size = sym.copy(), size.copy()
        rows = np.arange(n)
        if width > 1:
            joint, score = self._look(sym[:, :-1], sym[:, 1:])
        while width > 1 and len(rows):
            best = score.argmax(axis=1)
            r = np.arange(len(rows))
            live = score[r, best] > -np.inf
            if not live.all():
                done = rows[~live]
                out_sym[done, :width], out_size[done, :width] = sym[~live], size[~live]
                sym, size, joint, score, rows, best = sym[live], size[live], joint[live], score[live], rows[live], best[live]
                r = np.arange(len(rows))
                if not len(rows):
                    break
            sym[r, best] = joint[r, best]
            size[r, best] += size[r, best + 1]
            many[rows] -= 1
            shift = np.arange(width - 1)[None, :]
            take = shift + (shift > best[:, None])
            sym, size = np.take_along_axis(sym, take, 1), np.take_along_axis(size, take, 1)
            width -= 1
            if width > 1:
                shift = np.arange(width - 1)[None, :]
                take = shift + (shift >= best[:, None])
                joint, score = np.take_along_axis(joint, take, 1), np.take_along_axis(score, take, 1)
                for at in (best - 1, best):
                    ok = np.flatnonzero((at >= 0) & (at < width - 1))
                    p = at[ok]
                    joint[ok, p], score[ok, p] = self._look(sym[ok, p], sym[ok, p + 1])
        if len(rows) and width <= 1:
            out_sym[rows, :width], out_size[rows, :width] = sym, size
        raw = out_sym.astype(np.int32)
        plain = ((out_sym >= 0) & (out_sym < self.base)) | (np.arange(out_sym.shape[1])[None, :] >= many[:, None])
        whole = plain.all(axis=1)
        out = []
        for i, x in enumerate(chunks):
            m = many[i]
            if whole[i]:
                out.append(raw[i, :m].tobytes())
            else:
                ends = np.cumsum(out_size[i, :m])
                out.append(self._ids(out_sym[i, :m].tolist(), x, zip((ends - out_size[i, :m]).tolist(), ends.tolist(), strict=True)))
        return out

    def encode_chunks(self, chunks: list[str], check: bool = True) -> dict[str, bytes]:
        """int32 ids of each chunk, as bytes; checked against the library."""
        by: dict[int, list[str]] = {}
        for c in chunks:
            by.setdefault(len(c), []).append(c)
        out: dict[str, bytes] = {}
        for width, own in by.items():
            if width > _SHORT:
                out |= {c: self.by_heap(c) for c in own}
            else:
                for i in range(0, len(own), 1 << 14):
                    part = own[i : i + (1 << 14)]
                    out |= dict(zip(part, self.side_by_side(part), strict=True))
        if check and chunks:
            for c, ids in zip(chunks, self.library.encode(["\n" + c for c in chunks], num_threads=1), strict=True):
                if np.array(ids[2:], np.int32).tobytes() != out[c]:
                    raise ValueError(f"the library encodes {c!r} as {ids[2:]}")
        return out

    def check_pieces(self) -> None:
        """What every id decodes to, alone and after a plain piece; decoding puts these together."""
        plain = int(np.flatnonzero(~self.silent & ~self.marked & (self.length > 0))[-1])
        for lists in ([[i] for i in range(self.base)], [[plain, i, plain] for i in range(self.base)]):
            for ids, text in zip(lists, self.library.decode(lists, num_threads=1), strict=True):
                if self.decode(np.array(ids)) != text:
                    raise ValueError(f"the library decodes {ids} to {text!r}")

    def check_whole(self, text: str, ids: np.ndarray, decoded: str | None) -> None:
        """Both directions of a whole text against the library."""
        own = ids.tolist()
        if self.library.encode(text) != own or (decoded is not None and self.library.decode(own) != decoded):
            raise ValueError(f"the library differs on a text of {len(text)} characters that begins {text[:40]!r}")

    def encode(self, texts: list[str | None], check: bool = True) -> list[np.ndarray]:
        lists = [self.chunks(t or "") for t in texts]
        known: dict[str, bytes] = {}
        new = []
        for c in set().union(*lists):
            ids = self.young.get(c) or self.old.get(c)
            if ids is None:
                new.append(c)
            else:
                known[c] = self.young[c] = ids
        got = self.encode_chunks(new, check)
        known |= got
        self.young |= {c: v for c, v in got.items() if len(c) <= _SHORT}
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
            if len(self.old) > 4 * CACHE:
                self.old = {}
        return [np.frombuffer(b"".join(map(known.__getitem__, x)), np.int32) for x in lists]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the first piece that isn't a control piece loses a mark at its start, if it has one."""
        ids = np.asarray(ids, np.int64)
        length, start = self.length[ids], self.start[ids]
        heard = np.flatnonzero(~self.silent[ids])
        if len(heard) and self.marked[ids[heard[0]]]:
            length[heard[0]] -= 1
            start[heard[0]] += 1
        total = int(length.sum())
        at = np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)
        return self.flat[at].tobytes().decode("utf-8", "each_byte")


def vocabulary(model: bytes) -> Vocabulary:
    """The model's vocabulary, which stays in the worker, chunks that it has met included, until another operator's task."""
    loaded = KEPT.setdefault("pieces", {})
    key = hashlib.sha256(model).digest()
    if key not in loaded:
        loaded[key] = Vocabulary(model)
        loaded[key].check_pieces()
    return loaded[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _model(spark, path: str | None):
    with open(path or default_model(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # one vocabulary file, of a fixed size


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))


def _with(docs: DataFrame, fields: dict[str, T.DataType]) -> tuple[DataFrame, T.StructType]:
    docs = docs.drop(*fields)
    return docs, T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in fields.items())])


def encode_documents(docs: DataFrame, model_path: str | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """The documents with an array of ids (null text: none) and, where a name is given, the text decoded from them.

    All other columns stay; columns of the new names give way. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    model = _model(docs.sparkSession, model_path)
    docs, schema = _with(docs, {ids_col: T.ArrayType(T.IntegerType())} | ({decoded_col: T.StringType()} if decoded_col else {}))
    at = docs.columns.index(text_col)

    def run(batches):
        vocab = vocabulary(model.value)
        for batch in batches:
            column = batch.column(at).cast(pa.large_binary()).to_pylist()
            texts = ["" if t is None else t.decode("utf-8", "replace") for t in column]
            ids = vocab.encode(texts)
            back = [vocab.decode(x) for x in ids] if decoded_col else None
            if texts:
                vocab.check_whole(texts[0], ids[0], back[0] if back else None)
            new = [_lists(ids), *([pa.array(back, pa.string())] if decoded_col else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)
            del column, texts, ids, back, new
            trim()

    return docs.mapInArrow(lean(run, "pieces"), schema)


def decode_documents(docs: DataFrame, model_path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The documents with the text of their ids (null: empty)."""
    model = _model(docs.sparkSession, model_path)
    docs, schema = _with(docs, {text_col: T.StringType()})
    at = docs.columns.index(ids_col)

    def run(batches):
        vocab = vocabulary(model.value)
        for batch in batches:
            texts = [vocab.decode(np.array(x or [], np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return docs.mapInArrow(lean(run, "pieces"), schema)


def digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside doc_id."""
    joined = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    return encoded.select("doc_id", F.size(ids_col).cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.encode(decoded_col, "UTF-8"), 256).alias("decoded_sha256"))
