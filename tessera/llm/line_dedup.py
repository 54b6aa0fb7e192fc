"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

``LineIndex`` holds two tables. ``refs`` has for each line key the number of documents that hold it (exact, by a 128-bit
hash); ``filters`` has for each shard a cuckoo filter of the keys that at least ``min_docs`` documents hold. Inserting
documents adds to the counts and puts keys that reach the threshold into their shard's filter; deleting documents
subtracts and takes keys that fall below it out again, so the state is what a fresh build over the remaining documents
would give. Applying the index probes each distinct key of a block of documents in its shard's filter and confirms hits
in ``refs``, so a filter's false positives never drop a line.

A key that every document holds is counted by partial sums before any shuffle, meets its shard once a block, and comes
back once a block; no task grows with a line's frequency.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.blocks import block_count, block_of
from tessera.llm.store import lean, lean_tables, small_batches, stash
from tessera.llm.textnp import SECOND_TABLE, U, batch_bytes, lowered, mix, slices, span_hashes, words

SLOTS = 4
#: So many line keys, over the threshold or not, have a shard of their own.
SHARD_KEYS = 500_000


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, two buckets to a key, for 64-bit key hashes; supports deletion."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(2, math.ceil(math.log2(max(1, keys) / SLOTS / 0.8))), SLOTS), np.uint16))

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter of the keys, larger ones being tried until all fit."""
        size = len(hashes)
        while True:
            new = cls.sized(size)
            if new.insert_all(hashes):
                return new
            size *= 2

    def to_bytes(self) -> bytes:
        return self.buckets.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, mask = np.asarray(hashes, U), U(len(self.buckets) - 1)
        mark = (h >> U(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = h & mask
        return mark, first, first ^ (mix(mark.astype(U)) & mask)

    def insert(self, key: int) -> bool:
        """False, and the filter unchanged, if there is no room."""
        mark, a, b = (x[0] for x in self._places(np.array([key], U)))
        moves, at = [], int(a)
        for bucket in (int(a), int(b)):
            free = np.flatnonzero(self.buckets[bucket] == 0)
            if len(free):
                self.buckets[bucket, free[0]] = mark
                return True
        for k in range(500):
            slot = (k * 7 + int(mark)) % SLOTS
            moves.append((at, slot, self.buckets[at, slot]))
            self.buckets[at, slot], mark = mark, self.buckets[at, slot]
            at = int(U(at) ^ (mix(np.array([mark], U))[0] & U(len(self.buckets) - 1)))
            free = np.flatnonzero(self.buckets[at] == 0)
            if len(free):
                self.buckets[at, free[0]] = mark
                return True
        for at, slot, was in reversed(moves):
            self.buckets[at, slot] = was
        return False

    def insert_all(self, hashes: np.ndarray) -> bool:
        """Many keys at once: rounds in which keys take the free slots of one of their buckets, then of the other; those
        that find none move others. False if one has no room; the filter is of no use then."""
        mark, a, b = self._places(hashes)
        left = np.arange(len(mark))
        for choice in (a, b):
            at = choice[left].astype(np.int64)
            by = np.argsort(at, kind="stable")
            left, at = left[by], at[by]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            free = np.argsort(self.buckets[at] != 0, axis=1, kind="stable")
            fits = rank < (self.buckets[at] == 0).sum(axis=1)
            self.buckets[at[fits], free[fits, rank[fits]]] = mark[left[fits]]
            left = left[~fits]
        keys = np.asarray(hashes, U)
        return all(self.insert(int(keys[k])) for k in left)

    def delete_all(self, hashes: np.ndarray) -> None:
        """Take out one copy of each key; all were inserted before."""
        mark, a, b = self._places(hashes)
        left = np.arange(len(mark))
        while len(left):
            here = self.buckets[a[left]] == mark[left, None]
            at = np.where(here.any(axis=1), a[left], b[left]).astype(np.int64)
            held = self.buckets[at] == mark[left, None]
            known = held.any(axis=1)
            left, flat = left[known], at[known] * SLOTS + held[known].argmax(axis=1)
            flat, own = np.unique(flat, return_index=True)
            self.buckets.reshape(-1)[flat] = 0
            left = np.delete(left, own)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return ((self.buckets[a] == mark[:, None]) | (self.buckets[b] == mark[:, None])).any(axis=1)


def line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """Start and end of each line, lines of each row, whether its key counts, and both halves of the key's hash."""
    own = lowered(data)
    breaks = np.flatnonzero(own == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    many = np.diff(np.searchsorted(breaks, offsets)) + 1
    w, e, _ = words(own, offsets)
    i, j = np.searchsorted(w, starts), np.searchsorted(e, ends, "right")
    full = i < j
    a, b = w[i[full]], e[j[full] - 1]
    h1, h2 = np.zeros(len(starts), U), np.zeros(len(starts), U)
    h1[full], h2[full] = span_hashes(own, a, b), span_hashes(own, a, b, SECOND_TABLE)
    if min_chars > 1:
        chars = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
        full[full] = chars[b] - chars[a] >= min_chars
    elif min_chars < 1:
        full[:] = True
    return starts, ends, many, full, h1, h2


def _count_lines(min_chars: int):
    """(block, text) -> for each block of a batch its distinct keys and how many of its documents hold them."""

    def run(batches):
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = batch_bytes(batch.column(1))
            for i, j in slices(offsets):
                _, _, many, good, h1, h2 = line_keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_chars)
                row = np.repeat(np.arange(j - i), many)[good]
                h1, h2 = h1[good], h2[good]
                order = np.lexsort((row, h2, h1))
                row, h1, h2 = row[order], h1[order], h2[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                b, h1, h2 = block[i:j][row[new]], h1[new], h2[new]
                order = np.lexsort((h2, h1, b))
                b, h1, h2 = b[order], h1[order], h2[order]
                new = np.ones(len(b), bool)
                new[1:] = (b[1:] != b[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(b[at], pa.int32()), pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(np.diff(np.append(at, len(b))), pa.int64())], names=["block", "h1", "h2", "n"])

    return run


def _refilter(filters: pa.Table, moves: pa.Table) -> pa.Table:
    """A shard's filter with keys put in (up) or taken out (not up)."""
    shard = (filters if filters.num_rows else moves).column("shard")[0].as_py()
    up = moves.column("up").to_numpy(zero_copy_only=False).astype(bool)
    keys = moves.column("h1").to_numpy().view(U)
    held = filters.column("held")[0].as_py() if filters.num_rows else 0
    now = CuckooFilter.from_bytes(filters.column("filter")[0].as_py()) if filters.num_rows else CuckooFilter.of(keys[up])
    fits = True
    if filters.num_rows:
        now.delete_all(keys[~up])
        fits = now.insert_all(keys[up])
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([now.to_bytes()], pa.binary()), "held": pa.array([held + int(up.sum()) - int((~up).sum())], pa.int64()), "full": pa.array([not fits], pa.bool_())})


def _probe(filters: pa.Table, pairs: pa.Table) -> pa.Table:
    if filters.num_rows and pairs.num_rows:
        hit = CuckooFilter.from_bytes(filters.column("filter")[0].as_py()).holds(pairs.column("h1").to_numpy().view(U))
        pairs = pairs.filter(pa.array(hit))
    else:
        pairs = pairs.slice(0, 0)
    return pairs.select(["block", "h1", "h2"])


def _drop_lines(text_col: str, min_chars: int):
    """A block's documents and its keys to drop -> the documents with the other lines, n_lines and n_dropped."""

    def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
        k1, k2 = (np.concatenate([np.asarray(x, np.int64) for x in keys.column(c).to_pylist()] or [np.zeros(0, np.int64)]).view(U) for c in ("h1s", "h2s"))
        order = np.argsort(k1, kind="stable")
        k1, k2 = k1[order], k2[order]
        pairs = set(zip(k1.tolist(), k2.tolist(), strict=True))
        data, offsets = batch_bytes(docs.column(text_col))
        texts: list[bytes] = []
        n_lines, n_dropped = [], []
        for i, j in slices(offsets):
            own = data[offsets[i] : offsets[j]]
            off = offsets[i : j + 1] - offsets[i]
            starts, ends, many, good, h1, h2 = line_keys(own, off, min_chars)
            drop = np.zeros(len(starts), bool)
            if len(k1):
                at = np.searchsorted(k1, h1)
                maybe = np.flatnonzero(good & (at < len(k1)) & (k1[np.minimum(at, len(k1) - 1)] == h1))
                drop[maybe] = [(int(a), int(b)) in pairs for a, b in zip(h1[maybe], h2[maybe], strict=True)]
            lost = np.add.reduceat(drop.astype(np.int64), np.cumsum(many) - many)
            n_lines.append(many)
            n_dropped.append(lost)
            raw, first = own.tobytes(), np.cumsum(many) - many
            for r in range(j - i):
                if lost[r]:
                    span = range(first[r], first[r] + many[r])
                    texts.append(b"\n".join(raw[starts[x] : ends[x]] for x in span if not drop[x]))
                else:
                    texts.append(raw[off[r] : off[r + 1]])
        out = docs.drop_columns(["__block"])
        out = out.set_column(out.column_names.index(text_col), text_col, pa.array(texts, pa.binary()).cast(pa.string()))
        for name, parts in (("n_lines", n_lines), ("n_dropped", n_dropped)):
            out = out.append_column(name, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))
        return out

    return run


def _merged(spark, new: DataFrame, old: DataFrame | None, sign: int) -> DataFrame:
    """Exact counts after the change, with whether a key is over the threshold being left to the caller."""
    new = new.select("h1", "h2", (F.col("n") * sign).alias("n"), F.lit(0).cast("long").alias("was"))
    both = new if old is None else new.unionByName(old.select("h1", "h2", "n", F.col("n").alias("was")))
    return both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))


@dataclass
class LineIndex:
    """Reference counts (h1, h2, n) and filters (shard, filter, held) of the lines of a set of documents."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int
    text_col: str

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", lines: DataFrame | None = None) -> LineIndex:
        """From nothing. No document: no counts and no filters. ``lines``: the documents' line_counts, if they are there."""
        if lines is None:
            lines = line_counts(docs, text_col, min_chars)
        merged = stash(_merged(docs.sparkSession, lines, None, 1))
        empty = docs.sparkSession.createDataFrame([], "shard int, filter binary, held long")
        return cls(merged, empty, 0, min_docs, min_chars, text_col)._settled(merged)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents' lines counted in."""
        return self._settled(stash(_merged(docs.sparkSession, line_counts(docs, self.text_col, self.min_chars), self.refs, 1)))

    def delete(self, docs: DataFrame) -> LineIndex:
        """With the lines of documents that were inserted before counted out; undoes ``insert`` exactly."""
        return self._settled(stash(_merged(docs.sparkSession, line_counts(docs, self.text_col, self.min_chars), self.refs, -1)))

    def _shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod("h2", F.lit(self.shards)).cast("int"))

    def _settled(self, merged: DataFrame) -> LineIndex:
        """Filters brought up to the new counts. Shards double with the keys, and are then filled anew from the counts."""
        keys, shards = merged.count(), max(16, self.shards)
        while keys > shards * SHARD_KEYS:
            shards *= 2
        over, before = F.col("n") >= self.min_docs, F.col("was") >= self.min_docs
        if shards != self.shards:
            none = self.filters.sparkSession.createDataFrame([], "shard int, filter binary, held long")
            self = LineIndex(self.refs, none, shards, self.min_docs, self.min_chars, self.text_col)
            before = F.lit(False)
        moves = self._shard(merged.where(over != before)).select("shard", "h1", over.alias("up"))
        step = stash(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(lean_tables(_refilter, both=True), "shard int, filter binary, held long, full boolean"))
        refs = merged.where("n > 0").select("h1", "h2", "n")
        good = step.where("not full").select("shard", "filter", "held")
        if step.where("full").limit(1).count():  # a filter is out of room: those shards anew, from the counts
            again = self._shard(refs.where(over)).join(step.where("full").select("shard"), "shard").select("shard", "h1", F.lit(True).alias("up"))
            none = good.where("false")
            good = good.unionByName(none.groupBy("shard").cogroup(again.groupBy("shard")).applyInArrow(lean_tables(_refilter, both=True), "shard int, filter binary, held long, full boolean").drop("full"))
        return LineIndex(refs, stash(good), self.shards, self.min_docs, self.min_chars, self.text_col)

    def apply(self, docs: DataFrame, n_blocks: int | None = None, lines: DataFrame | None = None) -> DataFrame:
        """The documents without the lines whose key at least min_docs counted documents hold; n_lines, n_dropped.

        Null text counts as one empty line and comes back empty. Every other column stays as it is, but columns named
        n_lines or n_dropped give way. A document that loses all lines has an empty text. Every row is a document of its
        own: rows that repeat a doc_id, or are equal in all, count as often as they stand there.
        """
        n = n_blocks or block_count(docs, self.text_col)
        if lines is None:
            lines = line_counts(docs, self.text_col, self.min_chars, n)
        pairs = self._shard(lines.select("block", "h1", "h2").distinct())
        maybe = self.filters.groupBy("shard").cogroup(pairs.groupBy("shard")).applyInArrow(lean_tables(_probe, both=True), "block int, h1 long, h2 long")
        sure = maybe.join(self.refs.where(F.col("n") >= self.min_docs).select("h1", "h2"), ["h1", "h2"])
        keys = sure.groupBy(F.col("block").alias("__block")).agg(F.collect_list("h1").alias("h1s"), F.collect_list("h2").alias("h2s"))
        docs = docs.drop("n_lines", "n_dropped")
        held = docs.withColumn("__block", block_of(n, *_block_key(docs, self.text_col))).repartition(n, "__block")
        schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        return held.groupBy("__block").cogroup(keys.groupBy("__block")).applyInArrow(lean_tables(_drop_lines(self.text_col, self.min_chars), both=True), schema)


def _block_key(docs: DataFrame, text_col: str) -> list[str]:
    return [*(["doc_id"] if "doc_id" in docs.columns else []), text_col]


def line_counts(docs: DataFrame, text_col: str, min_chars: int, n_blocks: int = 1) -> DataFrame:
    """(block, h1, h2, n): the keys of each block of documents, in parts to be summed."""
    small_batches(docs.sparkSession)
    rows = docs.select(block_of(n_blocks, *_block_key(docs, text_col)).alias("block"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_count_lines(min_chars)), "block int, h1 long, h2 long, n long")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """Index the documents and apply the index to them; see ``LineIndex.apply`` for what comes back."""
    n = block_count(docs, text_col)
    lines = stash(line_counts(docs, text_col, min_chars, n))
    return LineIndex.build(docs, min_docs, min_chars, text_col, lines).apply(docs, n, lines)
