"""Ranked lexical search on a bit-sliced impact index.

The impact of a term in a document is an integer (weight times damped frequency). For a block of documents a term's impacts
are bitmaps, one for each bit, with a document for each place. A query adds the slices of its terms by bitwise carry
arithmetic, pairs of terms side by side, so each machine word adds for 64 documents at once. The best k are found from the
most significant slice down: a slice either leaves enough candidates, which then all have that bit, or its documents are in.

Texts are read once for each block of queries: what stays of a document are its length and how often it holds the queries'
terms. A query block has a stated number of items and bytes, so its vocabulary and weights are small whatever the corpus.
A task keeps k documents a query and no more. Terms are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import small_batches, stash
from tessera.llm.textnp import NO_TERM, batch_bytes, lowered, slices, span_hashes, words

#: Documents of a block of the index, and bytes of slices that a task keeps from one query to the next.
BLOCK_DOCS = 1 << 13
CACHE_BYTES = 160 << 20
#: A block of queries: so many items and bytes of text at most (a longer item is a block of its own).
BLOCK_ITEMS, BLOCK_ITEM_BYTES = 4096, 1 << 20
_BUCKETS = 256


def term_hashes(column: pa.Array):
    """(first row, last row + 1, hash of every term, terms by row), in slices of rows."""
    data, offsets = batch_bytes(column)
    for i, j in slices(offsets):
        own = lowered(data[offsets[i] : offsets[j]])
        starts, ends, counts = words(own, offsets[i : j + 1] - offsets[i], NO_TERM)
        yield i, j, span_hashes(own, starts, ends), counts


def _frequencies(vocabulary: np.ndarray):
    """Batches (doc_id, text) -> doc_id, n terms, terms of the vocabulary, how often each."""

    def run(batches):
        v = len(vocabulary)
        for batch in batches:
            for i, j, hashes, counts in term_hashes(batch.column(1)):
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(v - 1, 0))
                hit = vocabulary[at] == hashes if v else np.zeros(len(hashes), bool)
                row = np.repeat(np.arange(j - i), counts)[hit]
                pair, tf = np.unique(row * v + at[hit], return_counts=True)
                ends = np.concatenate(([0], np.cumsum(np.bincount(pair // max(v, 1), minlength=j - i)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % max(v, 1), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(counts.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def slices_of(places: np.ndarray, values: np.ndarray, docs: int) -> np.ndarray:
    """Bitmaps (bits, words of 64 places) of positive integers at places."""
    bits = int(values.max()).bit_length()
    flat = np.zeros((bits, -(-docs // 64) * 64), np.uint8)
    flat[:, places] = (values[None, :] >> np.arange(bits)[:, None]) & 1
    return np.packbits(flat, axis=1, bitorder="little").view(np.uint64)


def add_slices(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(terms, bits, words) + (terms, bits, words) -> (terms, bits + 1, words), bit by bit with a carry."""
    out = np.empty((a.shape[0], a.shape[1] + 1, a.shape[2]), np.uint64)
    carry = np.zeros((a.shape[0], a.shape[2]), np.uint64)
    for s in range(a.shape[1]):
        x, y = a[:, s], b[:, s]
        half = x ^ y
        np.bitwise_xor(half, carry, out=out[:, s])
        carry = (x & y) | (half & carry)
    out[:, -1] = carry
    return out


def total_slices(terms: list[np.ndarray]) -> np.ndarray:
    """(bits, words) of the sum over all terms."""
    bits = max(len(t) for t in terms)
    left = np.zeros((len(terms), bits, terms[0].shape[1]), np.uint64)
    for i, t in enumerate(terms):
        left[i, : len(t)] = t
    while len(left) > 1:
        odd = left[len(left) & ~1 :]
        left = add_slices(left[0 : len(left) & ~1 : 2], left[1::2])
        if len(odd):
            left = np.concatenate([left, np.pad(odd, ((0, 0), (0, 1), (0, 0)))])
    return left[0]


def best_places(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k largest sums above 0 (all, if fewer; of equal ones the first), and the sums."""
    sure, equal = np.zeros(total.shape[1], np.uint64), np.bitwise_or.reduce(total, axis=0)
    need = k
    if int(np.bitwise_count(equal).sum()) > k:
        for bit in total[::-1]:
            high = equal & bit
            n = int(np.bitwise_count(high).sum())
            if n > need:
                equal = high
            else:
                sure |= high
                need -= n
                equal &= ~bit
    at = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    places = np.concatenate([at(sure), at(equal)[:need]])
    places.sort()
    bits = (total[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    return places, (bits << np.arange(len(total), dtype=np.uint64)[:, None]).sum(axis=0).astype(np.int64)


class _Search:
    """One task: blocks of documents against all items of a query block, k documents an item."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.k = items, weights, np.int64(n_docs), np.int64(max(n_terms, 1)), k
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Documents by ascending id, those without one last (the largest number)."""
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids = ids[order]
        row = np.repeat(np.arange(len(ids)), counts)
        m = np.int64(50) + (np.int64(50) * lengths * self.n_docs) // self.n_terms
        tf = tfs.astype(np.int64)
        value = self.weights[terms] * ((np.int64(1_000_000_000) * tf) // (np.int64(1000) * tf + np.int64(20) * m[row]))
        by = np.argsort(terms, kind="stable")
        terms, value, row = terms[by], value[by], place[row[by]]
        keep = value > 0
        terms, value, row = terms[keep], value[keep], row[keep]
        known, first = np.unique(terms, return_index=True)
        span = dict(zip(known.tolist(), zip(first.tolist(), [*first.tolist()[1:], len(terms)], strict=True), strict=True))
        cache: dict[int, np.ndarray] = {}
        size = 0
        for item, wanted in self.items:
            own = []
            for t in wanted.tolist():
                if t in span:
                    if t not in cache:
                        a, b = span[t]
                        cache[t] = slices_of(row[a:b], value[a:b], len(ids))
                        size += cache[t].nbytes
                    own.append(cache[t])
            if own:
                places, score = best_places(total_slices(own), self.k)
                self.keep(item, ids[places], score)
            if size > CACHE_BYTES:
                cache, size = {}, 0

    def keep(self, item: int, ids: np.ndarray, score: np.ndarray) -> None:
        if item in self.best:
            ids, score = np.concatenate([self.best[item][0], ids]), np.concatenate([self.best[item][1], score])
        top = np.lexsort((ids, -score))[: self.k]
        self.best[item] = ids[top], score[top]


_LAST = np.iinfo(np.int64).max


def _rank(items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches):
        task = _Search(items, weights, n_docs, n_terms, k)
        held: list[pa.RecordBatch] = []

        def block() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = (t.column(c).combine_chunks() for c in ("terms", "tfs"))
            terms = terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms
            tfs = tfs.chunk(0) if isinstance(tfs, pa.ChunkedArray) else tfs
            task.block(t.column("doc_id").fill_null(_LAST).to_numpy(), t.column("n").to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(), tfs.flatten().to_numpy())
            held.clear()

        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                if rows + part.num_rows > BLOCK_DOCS:
                    block()
                    rows = 0
                held.append(part)
                rows += part.num_rows
        if rows:
            block()
        for item, (ids, score) in task.best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=ids == _LAST), pa.array(score)], names=["item", "doc_id", "score"])

    return run


def _first(rows: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _one_block(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    held = asked.toArrow()  # BLOCK_ITEMS items and BLOCK_ITEM_BYTES of text at most, or one item
    own: list[np.ndarray] = []
    for i, j, hashes, counts in term_hashes(held.column("text").combine_chunks()):
        own += [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])] if j > i else []
    vocabulary = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)])).astype(np.uint64)
    items = [(item, np.searchsorted(vocabulary, x)) for item, x in zip(held.column("item").to_pylist(), own, strict=True) if len(x)]
    found = stash(rows.mapInArrow(_frequencies(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0"))
    size = found.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row for each term asked at most
        df[r[0]] = r[1]
    weights = np.array([math.floor(1000 * math.log((2 * size.docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    return found.where(F.size("terms") > 0).mapInArrow(_rank(items, weights, size.docs, size.terms, k), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of ``items`` its k best documents: item_id, rank (from 1), doc_id, score, scores above 0 only.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, ASCII capitals folded. With N documents
    that have terms, L terms in all, n in the document, df documents with the term and tf of it in the document: weight
    w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + 50 n N div L, and the score sums w * (10^9 tf div (1000 tf + 20 m)) over an
    item's distinct terms. Equal scores ascend by id, documents without an id last. Every row of ``docs`` is a document, every
    row of ``items`` a query, also where ids repeat; null or empty texts find nothing. No rows on either side give no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = stash(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()))
    have = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, math.ceil(2 * have.n / BLOCK_ITEMS), math.ceil(2 * have.b / BLOCK_ITEM_BYTES)) if have.n > BLOCK_ITEMS or have.b > BLOCK_ITEM_BYTES else 1
    found = [_one_block(rows, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i), k) for i in range(blocks)]
    all_found = found[0]
    for x in found[1:]:
        all_found = all_found.unionByName(x)
    near = _first(all_found, ["item", F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS))], k).drop("rank")
    return _first(near, ["item"], k).join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
