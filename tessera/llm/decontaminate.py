"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

Every window with as many words as a benchmark item is compared with that item. A window whose weighted shingle
similarity (sum of the smaller counts over sum of the larger ones) is above 0 shares a shingle with the item, so windows
are laid at every start around the shingles that occur in some item, and nowhere else. Each gets a SimHash of 128 bits
over its shingles. The index has 16 blocks of 8 bits; a block lists for each of its 256 values the items within two bits,
so by the pigeonhole principle every item within radius 47 of a window is found in one block at least. Those within the
radius are confirmed on shingle counts. At a similarity of 0.8, fingerprints differ in 19 bits on average (deviation 4).

Items are a stated query set: they are sent to all rows in blocks of bounded size, one pass for each.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import lean, small_batches
from tessera.llm.textnp import U, batch_bytes, lowered, mix, shingles, slices, span_hashes, words

BITS, BLOCKS, ERRORS = 128, 16, 2
RADIUS = BLOCKS * (ERRORS + 1) - 1
ITEM_BYTES = 16 << 20
_POP8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 128 bits of each shingle."""
    raw = np.stack((h, mix(h ^ U(0x3C6EF372FE94F82B))), axis=1).astype("<u8").view(np.uint8)
    return np.unpackbits(raw, axis=1).astype(np.int32) * 2 - 1


@dataclass
class Group:
    """Items of one number of words."""

    width: int
    many: int
    ids: np.ndarray
    counts: list[Counter]
    prints: np.ndarray
    near: np.ndarray  # block, value: the items (bits) within ERRORS bits


class ItemIndex:
    def __init__(self, ids: list[int], texts: list[str | None], k: int):
        data, offsets = batch_bytes(pa.array(texts, pa.string()))
        own = lowered(data)
        starts, ends, many = words(own, offsets)
        hashes = span_hashes(own, starts, ends)
        at = np.concatenate(([0], np.cumsum(many)))
        self.k, self.groups = k, {}
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, item in enumerate(ids):
            if many[i]:
                by.setdefault(int(many[i]), []).append((item, shingles(hashes[at[i] : at[i + 1]], many[i : i + 1], k)[0]))
        xor = _POP8[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= ERRORS
        seeds: dict[int, tuple[list, list]] = {}
        for width, own_items in sorted(by.items()):
            prints = np.stack([np.packbits(signs(s).sum(axis=0) > 0) for _, s in own_items])
            near = np.stack([np.packbits(xor[:, prints[:, b]], axis=1) for b in range(BLOCKS)])
            self.groups[width] = Group(width, len(own_items[0][1]), np.array([i for i, _ in own_items]), [Counter(s.tolist()) for _, s in own_items], prints, near)
            h, w = seeds.setdefault(min(width, k), ([], []))
            for _, s in own_items:
                u = np.unique(s)
                h.append(u)
                w.append(np.full(len(u), width))
        self.seeds = {}
        for size, (h, w) in seeds.items():
            pair = np.unique(np.stack((np.concatenate(h), np.concatenate(w).astype(U))), axis=1)
            room = 1 << max(12, math.ceil(math.log2(16 * pair.shape[1])))
            flag = np.zeros(room, bool)
            flag[(pair[0] & U(room - 1)).astype(np.int64)] = True
            self.seeds[size] = (pair[0], pair[1].astype(np.int64), flag)

    def match_row(self, doc: np.ndarray, seed: np.ndarray, group: Group, least: float) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window for each item found; doc: the row's shingles."""
        n, total = group.many, len(doc)
        if total <= n:
            starts = np.zeros(1, np.int64)
        else:
            edge = np.zeros(total - n + 2, np.int64)
            np.add.at(edge, np.clip(seed - n + 1, 0, total - n + 1), 1)
            np.add.at(edge, np.minimum(seed + 1, total - n + 1), -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        best: dict[int, tuple[float, int]] = {}
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
            for run in np.array_split(part, max(1, len(part) // 4096)):
                if not len(run):
                    continue
                low, high = int(run[0]), min(total, int(run[-1]) + n)
                sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(signs(doc[low:high]), axis=0)))
                prints = np.packbits(sums[np.minimum(run + n, high) - low] - sums[run - low] > 0, axis=1)
                found = group.near[0][prints[:, 0]]
                for b in range(1, BLOCKS):
                    found = found | group.near[b][prints[:, b]]
                w, i = np.nonzero(np.unpackbits(found, axis=1, count=len(group.ids)))
                close = _POP8[prints[w] ^ group.prints[i]].sum(axis=1, dtype=np.int64) <= RADIUS
                for a, item in zip(w[close].tolist(), i[close].tolist(), strict=True):
                    start = int(run[a])
                    window = doc[start : start + n]
                    have, here = group.counts[item], Counter(window.tolist())
                    both = sum(min(c, have[h]) for h, c in here.items() if h in have)
                    sim = both / (n + len(window) - both)
                    if sim >= least and (item not in best or sim > best[item][0]):
                        best[item] = (sim, start)
        return [(int(group.ids[i]), s, at) for i, (s, at) in sorted(best.items())]

    def matches(self, column: pa.Array, least: float):
        """(row, item, similarity, first word, words of the item) of a column of texts."""
        data, offsets = batch_bytes(column)
        for i, j in slices(offsets):
            own = lowered(data[offsets[i] : offsets[j]])
            starts, ends, many = words(own, offsets[i : j + 1] - offsets[i])
            hashes = span_hashes(own, starts, ends)
            for size, (keys, widths, flag) in self.seeds.items():
                values, counts = shingles(hashes, many, size)
                maybe = np.flatnonzero(flag[(values & U(len(flag) - 1)).astype(np.int64)])
                lo, hi = np.searchsorted(keys, values[maybe]), np.searchsorted(keys, values[maybe], "right")
                maybe, lo, hi = maybe[lo < hi], lo[lo < hi], hi[lo < hi]
                if not len(maybe):
                    continue
                at = np.concatenate(([0], np.cumsum(counts)))
                row = np.searchsorted(at, maybe, "right") - 1
                reps = hi - lo
                step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                pos, row, width = np.repeat(maybe, reps), np.repeat(row, reps), widths[np.repeat(lo, reps) + step]
                by = np.lexsort((pos, width, row))
                pos, row, width = pos[by], row[by], width[by]
                cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(width) != 0)) + 1
                for part in np.split(np.arange(len(pos)), cut):
                    r, w = int(row[part[0]]), int(width[part[0]])
                    if many[r] < min(w, self.k):
                        continue
                    for item, sim, start in self.match_row(values[at[r] : at[r + 1]], pos[part] - at[r], self.groups[w], least):
                        yield i + r, item, sim, start, w


def _indexes(benchmark: DataFrame, k: int, id_col: str, text_col: str):
    """The benchmark in blocks of about ITEM_BYTES, as broadcast indexes."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)) + 64 * F.count(F.lit(1))).first()[0]
    n = max(1, math.ceil(total / ITEM_BYTES))
    for b in range(n):
        own = sorted((r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).where("t is not null").collect())
        yield benchmark.sparkSession.sparkContext.broadcast(ItemIndex([i for i, _ in own], [t for _, t in own], k))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: for each document and item the best window (of equals the first)
    with a similarity of ``least`` or more. A document's repeated rows each give rows. Null, empty or blank texts and
    items match nothing; items of fewer words than ``k`` match as a whole; a document shorter than an item is one window.
    Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, similarity double, first_word long, n_words long"
    out = None
    for index in _indexes(benchmark, k, item_id_col, item_text_col):

        def run(batches, index=index):
            for batch in batches:
                found = list(index.value.matches(batch.column(1), least))
                r, item, sim, start, width = zip(*found, strict=True) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r, pa.int64())), pa.array(item, pa.int64()), pa.array(sim, pa.float64()), pa.array(start, pa.int64()), pa.array(width, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without those that hold a window like an item; all columns as they are. Cases as above."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, k, item_id_col, item_text_col):

        def run(batches, index=index):
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for r, *_ in index.value.matches(batch.column(at), least):
                    bad[r] = True
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
