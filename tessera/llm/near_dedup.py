"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is m*6 symbols of b = 16 bits, one for each of m*6 random orders of its shingle set. Documents
within Hamming distance 2m - 1 of each other have, by the pigeonhole principle, one of m chunks with at most one wrong
symbol; so for each chunk all patterns with one symbol left out are keys, and documents that share a key are candidates.
m follows from the threshold so that a pair just at it is missed with a chance under 1e-5.

Candidates are joined into groups by a star around each key's smallest member (linear in the key's members), and links
are confirmed on full shingle sets. A group that fits ``GROUP_BYTES`` is confirmed in one task, through an inverted index
and a breadth-first search that only meets unvisited members. A larger group is cut into blocks and every pair of
blocks is a task, so no task grows with a group, and no pair of different texts that is linked is left out of the
components. Exact copies count once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.store import lean, lean_tables, small_batches, stash
from tessera.llm.textnp import U, distinct_by_row, mix, text_shingles

CHUNK = 6
GROUP_BYTES = 24 << 20
MISS = 1e-5


def chunks_for(percent: int) -> int:
    """So many chunks that a pair at the threshold has one with an error at most, but for a chance of MISS."""
    j = percent / 100
    if j >= 1:
        return 1
    p = j**CHUNK + CHUNK * j ** (CHUNK - 1) * (1 - j)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - p)))


def signatures(values: np.ndarray, counts: np.ndarray, chunks: int) -> np.ndarray:
    """Rows of chunks*CHUNK symbols of 16 bits; every count is 1 at least."""
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    odd = mix(np.arange(1, chunks * CHUNK + 1, dtype=U)) | U(1)
    out = np.empty((len(counts), chunks * CHUNK), U)
    for i, a in enumerate(odd):
        out[:, i] = np.minimum.reduceat(mix_light(values, a), starts)
    return mix(out) & U(0xFFFF)


def mix_light(x: np.ndarray, a: np.uint64) -> np.ndarray:
    y = x * a
    y ^= y >> U(32)
    y *= U(0xD6E8FEB86659FD93)
    return y


def chunk_keys(symbols: np.ndarray, chunks: int) -> np.ndarray:
    """For each row the keys of every chunk with each one of its symbols left out."""
    place = mix(symbols + (np.arange(chunks * CHUNK, dtype=U) << U(20))).reshape(len(symbols), chunks, CHUNK)
    rest = place.sum(axis=2, keepdims=True, dtype=U) - place
    return mix(rest + np.arange(chunks * CHUNK, dtype=U).reshape(1, chunks, CHUNK) * U(0xA24BAED4963EE407)).reshape(len(symbols), -1)


def _sketch(shingle: int, chunks: int):
    def run(batches):
        for batch in batches:
            for i, j, values, counts in text_shingles(batch.column(1), shingle):
                values, counts = distinct_by_row(values, counts)
                n, full = len(counts), np.flatnonzero(counts)
                h, keys = np.zeros((2, n), U), np.zeros((0, chunks * CHUNK), U)
                if len(full):
                    starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
                    for k, salt in enumerate((0x1F83D9AB, 0x5BE0CD19)):
                        h[k, full] = np.add.reduceat(mix(values ^ U(salt)), starts)
                    keys = chunk_keys(signatures(values, counts[full], chunks), chunks)
                at = np.concatenate(([0], np.cumsum((counts > 0) * chunks * CHUNK)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).cast(pa.int64()) for c in (0, 2, 3)), pa.array(counts), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))], names=["doc_id", "text_hash", "bytes", "n", "h1", "h2", "keys"])

    return run


def link_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each sorted set the index of the first set that links reach: 100 * |a & b| >= percent * |a | b|."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    root = np.arange(n)
    if n < 2:
        return root
    owner, value = np.repeat(np.arange(n), size), np.concatenate(sets)

    def index(alive: np.ndarray):
        own, val = owner[alive[owner]], value[alive[owner]]
        order = np.argsort(val, kind="stable")
        val, own = val[order], own[order]
        first = np.flatnonzero(np.concatenate(([True], val[1:] != val[:-1]))) if len(val) else np.zeros(0, np.int64)
        return val[first], np.append(first, len(val)), own

    free = np.ones(n, bool)
    keys, at, own = index(free)
    indexed = left = n
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed], queue = False, [seed]
        left -= 1
        while queue and left:
            x = queue.pop()
            if left * 2 < indexed:
                keys, at, own = index(free)
                indexed = left
            where = np.searchsorted(keys, sets[x])
            where = where[(where < len(keys)) & (keys[np.minimum(where, len(keys) - 1)] == sets[x])]
            lengths = at[where + 1] - at[where]
            total = int(lengths.sum())
            if not total:
                continue
            step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            seen = own[np.repeat(at[where], lengths) + step]
            other, inter = np.unique(seen[free[seen]], return_counts=True)
            hit = other[100 * inter >= percent * (size[x] + size[other] - inter)]
            free[hit], root[hit] = False, seed
            left -= len(hit)
            queue.extend(hit.tolist())
    return root


def _confirm(shingle: int, percent: int):
    """Rows (task, grp, set, n, h1, text) of a task -> (a, b) with b the first linked set; groups apart. A text that isn't of
    its set (two texts of one id and hash) is passed over, and so is a set's second text."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("set", "ascending")])
        grp, node, n, h1 = (table.column(c).to_numpy() for c in ("grp", "set", "n", "h1"))
        sets: list[np.ndarray] = []
        ok: list[bool] = []
        last = None
        for _, _, values, counts in text_shingles(table.column("text"), shingle):
            values, counts = distinct_by_row(values, counts)
            at = np.concatenate(([0], np.cumsum(counts)))
            for i in range(len(counts)):
                s = values[at[i] : at[i + 1]]
                k = len(sets)
                right = len(s) == n[k] and len(s) > 0 and np.add.reduce(mix(s ^ U(0x1F83D9AB))).view(np.int64) == h1[k]
                ok.append(bool(right) and node[k] != last)
                last = node[k] if ok[-1] else last
                sets.append(s.copy() if ok[-1] else s[:0])
        a, b = [], []
        good = np.flatnonzero(ok)
        for part in np.split(good, np.flatnonzero(np.diff(grp[good])) + 1) if len(good) else []:
            root = link_sets([sets[i] for i in part], percent)
            a.append(node[part])
            b.append(node[part][root])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(cat(a), pa.int64()), "b": pa.array(cat(b), pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text) and
    group_id (a number for each component, null for a row that can have no links).

    A document's set is its distinct runs of ``shingle`` words (fewer words: the whole as one; null, empty or blank text:
    the empty set, linked with nothing). Documents with 100 * |a & b| >= percent * |a | b| are linked; component_id is the
    smallest id reachable, kept says whether it is the row's own. A row without an id is linked with nothing, has a null
    component_id and is kept. Rows that repeat an id are told apart by their sets: each has the component of its own text, and
    all rows of a component's smallest id are kept. Other columns aren't read. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    chunks = chunks_for(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns({"text_hash": F.xxhash64("text"), "bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    sketch = stash(rows.mapInArrow(lean(_sketch(shingle, chunks)), "doc_id long, text_hash long, bytes long, n long, h1 long, h2 long, keys array<long>"))
    full = sketch.where("doc_id is not null and n > 0")
    found = full.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "bytes")).alias("r"), F.first("keys").alias("keys"))
    # Nodes are sets, each with a number of its own and the row of least id that shows it.
    reps = stash(found.select("n", "h1", "h2", F.col("r.doc_id").alias("rep"), "r.text_hash", "r.bytes", "keys", F.monotonically_increasing_id().alias("set")))
    keyed = reps.select("set", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("set").alias("low"), F.max("set").alias("high"), F.count(F.lit(1)).alias("c")).where("c > 1")
    ends = stash(ends)
    stars = ends.select(F.col("high").alias("a"), F.col("low").alias("b")).unionByName(keyed.join(ends.where("c > 2").select("key", "low"), "key").select(F.col("set").alias("a"), F.col("low").alias("b")))
    groups = components(stars.where("a <> b"))
    member = stash(groups.select(F.col("id").alias("set"), F.col("component").alias("grp")).join(reps.drop("keys"), "set").select("set", "grp", "rep", "text_hash", "bytes", "n", "h1"))
    sizes = member.groupBy("grp").agg(F.sum(F.greatest(F.col("bytes"), F.col("n") * 8)).alias("bytes"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(total / (8 << 20)))
    blocks = F.ceil(F.col("bytes") / (GROUP_BYTES // 2)).cast("int")
    own = F.pmod(F.xxhash64("set"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.concat_ws("-", F.col("grp"), F.least(o, own), F.greatest(o, own)))
    task = F.when(F.col("bytes") <= GROUP_BYTES, F.array(F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("string"))).otherwise(pair)
    plan = member.drop("bytes").join(sizes, "grp").select(F.col("rep").alias("doc_id"), "text_hash", "set", "grp", "n", "h1", F.explode(task).alias("task"))
    texts = rows.drop("bytes").join(plan.hint("merge"), ["doc_id", "text_hash"]).select("task", "grp", "set", "n", "h1", "text")
    if full.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():  # rows that are the same: one of them is enough
        texts = texts.dropDuplicates(["task", "set"])
    links = texts.groupBy("task").applyInArrow(lean_tables(_confirm(shingle, percent)), "a long, b long")
    named = stash(components(links).select(F.col("id").alias("set"), "component").join(reps.select("set", "rep"), "set"))
    low = named.groupBy("component").agg(F.min("rep").alias("low"))
    least = named.join(low, "component").select("set", "component", "low")
    final = stash(reps.join(least, "set", "left").select("n", "h1", "h2", F.coalesce("low", "rep").alias("component_id"), F.coalesce("component", "set").alias("group_id")))
    alone = sketch.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_hash", F.lit(None).cast("long").alias("group_id"))
    out = full.drop("keys").join(final, ["n", "h1", "h2"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"), "text_hash", "group_id").unionByName(alone)
