"""Language-model scoring by prediction by partial matching (PPM, method C escapes, full symbol exclusion).

A text is the byte stream of its words (ASCII capitals folded, one space between words) and an end byte. The trie holds
for every context of up to ``order`` bytes how often each byte followed it. A byte is coded in the longest known
context; a context that never saw it pays the escape D'/(T'+D') and hands over to the next shorter one, where all symbols
of the longer context are excluded (T', D': count and number of symbols left); below order 0 all bytes left are equal.

``ByteTrie`` is that model in plain form; it scores adaptively (it learns each byte after coding it) or pretrained.
``score_documents`` is the pretrained model for a corpus. The trie is split by the last two context bytes, so a shard
holds whole subtrees, and since counts are never truncated the symbols of a context are among those of its suffix: what
a context excludes is a property of the context, and the code length of each (context, byte) is computed once. A block of
documents sends each shard its distinct (context, byte) pairs with counts and gets their code lengths back; the word
counts of the base score travel the same way. Pairs travel packed, one row for a block and shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import block_count, block_of
from tessera.llm.store import small_batches, stash
from tessera.llm.textnp import U, batch_bytes, lowered, mix, span_hashes, words

END = 0x0A
GRAMS, WORDS, PAIRS = 0, 1, 2
_END_WORD = U(0x452821E638D01377)
_SLICE, _ROWS = 1 << 20, 1 << 15


class ByteTrie:
    """Counts of the bytes after each context of up to ``order`` bytes, and the PPM code length of a text."""

    def __init__(self, order: int = 5):
        self.order, self.next = order, {}

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            node = self.next.setdefault(context[len(context) - k :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def log10(self, context: bytes, symbol: int) -> float:
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            node = self.next.get(context[len(context) - k :])
            if not node:
                continue
            left = {s: c for s, c in node.items() if s not in excluded}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / total)
            if left:
                out += math.log10(len(left) / total)
            excluded = set(node)
        return out - math.log10(256 - len(excluded))

    def score(self, stream: bytes, learn: bool = False) -> float:
        """log10 probability of a stream; adaptive with ``learn``."""
        padded, total = bytes([END]) * self.order + stream, 0.0
        for i, s in enumerate(stream):
            context = padded[i : i + self.order]
            total += self.log10(context, s)
            if learn:
                self.learn(context, s)
        return total


def _streams(data: np.ndarray, offsets: np.ndarray):
    """Words as spans of a buffer in which each row ends with one spare byte: (buffer, starts, ends, words by row, row ends)."""
    lens = np.diff(offsets)
    buf = np.full(len(data) + len(lens), 0x20, np.uint8)
    inner = np.ones(len(buf), bool)
    inner[offsets[1:] + np.arange(len(lens))] = False
    buf[inner] = lowered(data)
    off = offsets + np.arange(len(offsets))
    return (buf, *words(buf, off), off)


def _keys(buf, starts, ends, many, off, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each coded byte: order context bytes and the byte itself in one integer, and its row."""
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    buf = np.where(keep, buf, np.uint8(0x20))
    keep[ends] = True
    last = np.cumsum(many)
    final = np.where(many > 0, ends[np.maximum(last - 1, 0)] if len(ends) else 0, off[1:] - 1)
    keep[final], buf[final] = True, END
    kept = np.flatnonzero(keep)
    size = np.diff(np.searchsorted(kept, off)).astype(np.int64)
    rows = len(size)
    stream = np.full(len(kept) + order * rows, END, np.uint8)
    row = np.repeat(np.arange(rows, dtype=np.int32), size)
    at = np.arange(len(kept), dtype=np.int32) + np.int32(order) * (row + np.int32(1))
    stream[at] = buf[kept]
    code = np.zeros(len(kept), U)
    for i in range(order, -1, -1):
        code <<= U(8)
        code |= stream[at - i]
    return code, row


def _cuts(offsets: np.ndarray):
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, min(i + _ROWS, int(np.searchsorted(offsets, offsets[i] + _SLICE, "right")) - 1))
        yield i, j
        i = j


def _sorted_keys(column: pa.Array, order: int):
    """For slices of rows: (i, j, keys sorted with their rows, word hashes sorted with their rows, words by row)."""
    data, offsets = batch_bytes(column)
    for i, j in _cuts(offsets):
        part = _streams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        code, row = _keys(*part, order)
        if order <= 5:
            packed = (code << U(16)) | row.astype(U)
            packed.sort()
            code, row = packed >> U(16), (packed & U(0xFFFF)).astype(np.int32)
        else:
            by = np.argsort(code, kind="stable")
            code, row = code[by], row[by]
        buf, starts, ends, many, _ = part
        h = np.concatenate((span_hashes(buf, starts, ends), np.full(j - i, _END_WORD)))
        w = np.concatenate((np.repeat(np.arange(j - i), many), np.arange(j - i)))
        by = np.argsort(h, kind="stable")
        yield i, j, (code, row), (h[by], w[by]), many


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys or [np.zeros(0, U)]), np.concatenate(counts or [np.zeros(0, np.int64)])
    by = np.argsort(k, kind="stable")
    k, c = k[by], c[by]
    f = _firsts(k)
    return k[f], (np.add.reduceat(c, f) if len(f) else c)


def _pack(keys: np.ndarray, kind: int, order: int) -> bytes:
    """Keys as bytes; those of 48 bits as their upper 32, which repeat in sorted order and so compress, and lower 16."""
    if kind == GRAMS and order <= 5:
        return (keys >> U(16)).astype(np.uint32).tobytes() + (keys & U(0xFFFF)).astype(np.uint16).tobytes()
    return keys.tobytes()


def _unpack(raw, kind: int, order: int) -> np.ndarray:
    if kind == GRAMS and order <= 5:
        n = len(raw) // 6
        return (np.frombuffer(raw, np.uint32, n).astype(U) << U(16)) | np.frombuffer(raw, np.uint16, n, 4 * n).astype(U)
    return np.frombuffer(raw, U)


def _shards(keys: np.ndarray, kind: int, n: int) -> np.ndarray:
    return (mix((keys >> U(8)) & U(0xFFFF) if kind == GRAMS else keys) % U(n)).astype(np.int64)


def _gather(order: int, shards: int):
    """A block's rows (block, learn, text) -> its distinct keys by shard, with counts over the rows to learn from."""

    def run(table: pa.Table) -> pa.Table:
        learn = table.column("learn").to_numpy().astype(np.int64)
        found = {GRAMS: ([], []), WORDS: ([], [])}
        for i, j, grams, own_words, _ in _sorted_keys(table.column("text"), order):
            for kind, (key, row) in ((GRAMS, grams), (WORDS, own_words)):
                f = _firsts(key)
                found[kind][0].append(key[f])
                found[kind][1].append(np.add.reduceat(learn[i:j][row], f))
        out = []
        pairs = np.zeros(1 << 16, np.int64)
        for kind, parts in found.items():
            key, count = _summed(*parts)
            if kind == GRAMS:
                np.add.at(pairs, (key & U(0xFFFF)).astype(np.int64), count)
            shard = _shards(key, kind, shards)
            by = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[by], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cut)):
                own = by[cut[s] : cut[s + 1]]
                out.append((int(s), kind, _pack(key[own], kind, order), count[own].astype(np.uint32 if count[own].max() < 1 << 32 else np.uint64).tobytes()))
        seen = np.flatnonzero(pairs)
        out.append((-1, PAIRS, seen.astype(np.uint16).tobytes(), pairs[seen].tobytes()))
        block = table.column("block")[0].as_py()
        return pa.table([pa.array([block] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary())], names=["block", "shard", "kind", "keys", "counts"])

    return run


def _pick(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """values at the wanted keys, 0 where there is none; keys are sorted."""
    if not len(keys):
        return np.zeros(len(want), values.dtype)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], 0)


def gram_lengths(code: np.ndarray, count: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of the last byte of each code after its context, for a shard's sorted distinct codes.

    pairs: counts of all (byte, next byte) of the whole corpus, 256 x 256; longer contexts are all in ``code``.
    """
    n = len(code)
    seen = count > 0
    key, num = code[seen], count[seen]
    levels = {}  # order: (sorted (context, symbol), count, sorted context, total, distinct)
    for k in range(order, 1, -1):
        if k < order:
            key, num = _summed([key & U((1 << 8 * (k + 1)) - 1)], [num])
        ctx = key >> U(8)
        f = _firsts(ctx)
        levels[k] = (key, num, ctx[f], np.add.reduceat(num, f) if len(f) else num, np.diff(np.append(f, len(ctx))))
    one, zero = pairs, pairs.sum(axis=0)
    out, done = np.zeros(n), np.zeros(n, bool)
    symbol, c1 = (code & U(0xFF)).astype(np.int64), ((code >> U(8)) & U(0xFF)).astype(np.int64)
    above_d, above_e = np.zeros(n, np.int64), np.zeros(n, np.int64)  # symbols of the next longer context, their count here
    for k in range(order, -1, -1):
        want = code & U((1 << 8 * (k + 1)) - 1)
        if k >= 2:
            key, num, ctx, total, distinct = levels[k]
            c, t, d = _pick(key, num, want), _pick(ctx, total, want >> U(8)), _pick(ctx, distinct, want >> U(8))
        elif k == 1:
            c, t, d = one[c1, symbol], one.sum(axis=1)[c1], (one > 0).sum(axis=1)[c1]
        else:
            c, t, d = zero[symbol], np.full(n, zero.sum()), np.full(n, (zero > 0).sum())
        t_left, d_left = t - above_e, d - above_d
        open_ = ~done & (t > 0)
        hit = open_ & (c > 0)
        out[hit] += np.log10(c[hit] / (t_left[hit] + d_left[hit]))
        esc = open_ & (c == 0) & (d_left > 0)
        out[esc] += np.log10(d_left[esc] / (t_left[esc] + d_left[esc]))
        done |= hit
        above_d = d
        if k >= 3:
            low_key, low_num = levels[k - 1][0], levels[k - 1][1]
            below = _pick(low_key, low_num, key & U((1 << 8 * k) - 1))
        elif k == 2:
            below = one[((key >> U(8)) & U(0xFF)).astype(np.int64), (key & U(0xFF)).astype(np.int64)]
        if k >= 2:
            f = _firsts(key >> U(8))
            above_e = _pick(ctx, np.add.reduceat(below, f) if len(f) else below, want >> U(8))
        elif k == 1:
            above_e = ((one > 0) @ zero)[c1]
    rest = ~done
    out[rest] -= np.log10(256 - (zero > 0).sum())
    return out


def _answer(order: int, pairs: np.ndarray):
    """A shard's keys of all blocks -> for each block the values in the order of its keys: log10 P, or the count."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        keys = [_unpack(x.as_buffer(), kind, order) for x in table.column("keys")]
        counts = [np.frombuffer(x.as_buffer(), np.uint32 if len(x.as_buffer()) == 4 * len(k) else U).astype(np.int64) for x, k in zip(table.column("counts"), keys, strict=True)]
        key, count = _summed(keys, counts)
        value = gram_lengths(key, count, pairs, order) if kind == GRAMS else count.astype(np.uint32 if count.max() < 1 << 32 else np.int64)
        blobs = [value[np.searchsorted(key, k)].tobytes() for k in keys]
        known = int((count > 0).sum()) if kind == WORDS else 0
        return pa.table([table.column("block"), table.column("shard"), table.column("kind"), pa.array(blobs, pa.binary()), pa.array([known] + [0] * (len(keys) - 1), pa.int64()), pa.array([int(count.sum()) if kind == WORDS else 0] + [0] * (len(keys) - 1), pa.int64())], names=["block", "shard", "kind", "vals", "v", "n"])

    return run


def _score(order: int, shards: int, keep: list[str]):
    """A block's rows and its values -> the kept columns, n_tokens, n_known, the sum of log10(c + 1), and the score."""

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        own_keys = {GRAMS: [], WORDS: []}
        for _, _, grams, own_words, _ in _sorted_keys(docs.column("text"), order):
            for kind, (key, _) in ((GRAMS, grams), (WORDS, own_words)):
                own_keys[kind].append(key[_firsts(key)])
        tables = {}
        for kind, parts in own_keys.items():  # the same keys in the same order as were sent
            key = np.unique(np.concatenate(parts)) if parts else np.zeros(0, U)
            shard = _shards(key, kind, shards)
            by = np.argsort(shard, kind="stable")
            cut, val = np.searchsorted(shard[by], np.arange(shards + 1)), np.zeros(len(key))
            got = values.filter(pa.array(values.column("kind").to_numpy() == kind))
            for s, raw in zip(got.column("shard").to_pylist(), got.column("vals"), strict=True):
                raw, many = raw.as_buffer(), cut[s + 1] - cut[s]
                x = np.frombuffer(raw, np.float64 if kind == GRAMS else np.uint32 if len(raw) == 4 * many else np.int64)
                val[by[cut[s] : cut[s + 1]]] = x if kind == GRAMS else np.log10(x.astype(np.float64) + 1)
            tables[kind] = key, val
        own_keys.clear()
        n = docs.num_rows
        tokens, known, logs, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for i, j, grams, own_words, many in _sorted_keys(docs.column("text"), order):
            tokens[i:j] = many + 1
            for kind, (key, row) in ((GRAMS, grams), (WORDS, own_words)):
                f = _firsts(key)
                k, v = tables[kind]
                val = np.repeat(v[np.searchsorted(k, key[f])], np.diff(np.append(f, len(key))))
                total = np.bincount(row, weights=val, minlength=j - i)
                if kind == GRAMS:
                    score[i:j] = total
                else:
                    logs[i:j] = total
                    known[i:j] = np.bincount(row[val > 0], minlength=j - i)
        out = docs.select(keep)
        for name, x in (("n_tokens", pa.array(tokens)), ("n_known", pa.array(known)), ("logs", pa.array(logs)), ("score", pa.array(score))):
            out = out.append_column(name, x)
        return out

    return run


def _add_pairs(batches):
    """Byte pair counts of blocks -> (pair, n), summed over all blocks of the task."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
            total[np.frombuffer(keys.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.int64)
    pair = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total[pair])], names=["pair", "n"])


def score_documents(docs: DataFrame, held_out: Column, order: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The models learn from the rows where ``held_out`` is false; null there counts as false. score: the PPM model's log10
    probability of the text; base_score: that of a word model with one added to every count, over the words and an end.
    Null, empty and blank texts are just the end. No rows give no rows. Other columns aren't read.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    n = block_count(rows, "text")
    shards = max(16, n)
    held = rows.withColumn("block", block_of(n, "doc_id", "text")).repartition(n, "block")
    sent = stash(held.select("block", (~F.col("held_out")).alias("learn"), "text").groupBy("block").applyInArrow(_gather(order, shards), "block int, shard int, kind int, keys binary, counts binary"))
    pairs = np.zeros(1 << 16, np.int64)
    summed = sent.where(F.col("kind") == PAIRS).select("keys", "counts").mapInArrow(_add_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # 65,536 rows at most
        pairs[row.pair] = row.n
    asked = sent.where(F.col("kind") != PAIRS).groupBy("shard", "kind")
    got = stash(asked.applyInArrow(_answer(order, pairs.reshape(256, 256)), "block int, shard int, kind int, vals binary, v long, n long"))
    total = got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, held_out boolean, n_tokens long, n_known long, logs double, score double"
    scored = held.groupBy("block").cogroup(got.select("block", "shard", "kind", "vals").groupBy("block")).applyInArrow(_score(order, shards, ["doc_id", "held_out"]), schema)
    base = F.col("logs") - F.col("n_tokens") * math.log10(total.n + total.v + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def adaptive_scores(docs: DataFrame, order: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: each text coded by a trie that starts empty and learns as it goes. Same texts and ends as above."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            scores = []
            for text in batch.column(1):
                buf, starts, ends, _, _ = _streams(*batch_bytes(pa.array([text.as_py()], pa.string())))
                stream = b" ".join(buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)) + bytes([END])
                scores.append(ByteTrie(order).score(stream, learn=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
