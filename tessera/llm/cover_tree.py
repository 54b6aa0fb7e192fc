"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are taken to the unit sphere, where a cosine of at least c is a distance of at most sqrt(2 - 2c). Equal vectors
count once, with their number. The rest are dealt into cells around centres from a bounded sample and each cell into
blocks of at most ``BLOCK`` vectors; a block gets a cover tree: levels of centres with halving radii, every centre among
those of the next level, every node with the exact distance to its farthest descendant. Two blocks are compared by going
down both trees at once; a pair of nodes goes when its centres are farther apart than both covering radii and the
threshold together. What is left at the bottom is decided by the cosine in double precision.

Blocks in cells that are too far apart never meet. The blocks of a cell form tiles of a few blocks, and two tiles meet in a
task, which goes through the pairs of their blocks and returns link counts and a spanning forest, not pairs. So a block is
shipped once for each tile it may meet, no task grows with a group, and links between near copies aren't laid out. Vectors
without structure (independent directions in many dimensions) are as far from each other as the covering bounds allow, so
there all tiles meet: the work is that of all pairs, the shuffle that divided by the vectors of a tile.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.store import small_batches, stash

BLOCK = 3000
#: Blocks of a tile at most, and tiles that a cell is cut into before tiles get more than one block.
TILE, LEAST_TILES = 8, 6
SAMPLE, CELLS, CELL_ROWS = 512, 64, 6000
_SLACK = 1e-3


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    np.multiply(d, -2, out=d)
    d += 2
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


class CoverTree:
    """levels: (centre, covering radius, parent's place in the level above) of each node; the last level is the points.

    A node's children are centres more than the level's radius apart, so that each of the node's points is within it of one;
    distances are only taken between a new centre and the points of its node that no centre covers yet.
    """

    def __init__(self, unit: np.ndarray):
        x = unit.astype(np.float32)
        n = len(x)
        root = int(np.argmax(x @ x.mean(axis=0)))
        centre, node_of = np.array([root]), np.zeros(n, np.int64)
        to_centre = _distances(x[root : root + 1], x)[0]
        self.levels = [(centre, np.array([to_centre.max()]), np.zeros(1, np.int64))]
        radius = 1.0
        while radius >= 0.1 and len(centre) < n:
            order = np.argsort(node_of, kind="stable")
            cut = np.searchsorted(node_of[order], np.arange(len(centre) + 1))
            new_centre, parent, new_node, to_centre = [], [], np.empty(n, np.int64), np.zeros(n, np.float32)
            for k in range(len(centre)):
                left = order[cut[k] : cut[k + 1]]
                left = np.concatenate(([centre[k]], left[left != centre[k]]))
                while len(left):
                    d = _distances(x[left[:1]], x[left])[0]
                    near = d <= radius
                    near[0] = True
                    new_node[left[near]], to_centre[left[near]] = len(new_centre), d[near]
                    new_centre.append(left[0])
                    parent.append(k)
                    left = left[~near]
            centre, node_of = np.array(new_centre), new_node
            far = np.zeros(len(centre), np.float32)
            np.maximum.at(far, node_of, to_centre)
            self.levels.append((centre, far, np.array(parent)))
            radius /= 2
        self.levels.append((np.arange(n), np.zeros(n, np.float32), node_of))


def linked(a: CoverTree, x: np.ndarray, b: CoverTree, y: np.ndarray, least: float) -> np.ndarray:
    """The matrix of links between the rows of x and y (unit vectors)."""
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + _SLACK
    depth = max(len(a.levels), len(b.levels))
    alive = None
    rows = cols = np.zeros(0, np.int64)
    for k in range(depth):
        (ca, ra, pa_), (cb, rb, pb) = a.levels[min(k, len(a.levels) - 1)], b.levels[min(k, len(b.levels) - 1)]
        if alive is not None:
            # A tree that has no more levels stays at its points.
            up = (pa_ if k < len(a.levels) else np.arange(len(ca)), pb if k < len(b.levels) else np.arange(len(cb)))
            row_ok, col_ok = alive.any(axis=1), alive.any(axis=0)
            full = (len(row_ok), len(col_ok))
            if not row_ok.any():
                return np.zeros((len(x), len(y)), bool)
            rows, cols = np.flatnonzero(row_ok[up[0]]), np.flatnonzero(col_ok[up[1]])
            inner = alive[np.ix_(up[0][rows], up[1][cols])]
            assert full[0] > up[0].max() and full[1] > up[1].max()
        else:
            rows, cols, inner = np.arange(len(ca)), np.arange(len(cb)), np.ones((len(ca), len(cb)), bool)
        last = k == depth - 1
        if last:
            inner &= x[rows] @ y[cols].T >= least
        else:
            d = _distances(x[ca[rows]].astype(np.float32), y[cb[cols]].astype(np.float32))
            d -= ra[rows, None]
            d -= rb[None, cols]
            inner &= d <= reach
        alive = np.zeros((len(ca), len(cb)), bool)
        alive[np.ix_(rows, cols)] = inner
    return alive


def _forest(links: np.ndarray, same: bool) -> np.ndarray:
    """For rows and columns (one after the other; the same ones if ``same``) the first of those that links reach."""
    n, m = links.shape
    root = np.full(n if same else n + m, -1)
    for i in np.flatnonzero(links.any(axis=1)):
        if root[i] >= 0:
            continue
        root[i], front = i, np.array([i])
        while len(front):
            cols = np.flatnonzero(links[front].any(axis=0))
            if same:
                front = cols[root[cols] < 0]
                root[front] = i
            else:
                cols = cols[root[n + cols] < 0]
                root[n + cols] = i
                front = np.flatnonzero(links[:, cols].any(axis=1)) if len(cols) else cols
                front = front[root[front] < 0]
                root[front] = i
    return root


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row as doubles; None if it is null, empty, zero or holds a null or a non-finite number."""
    flat, offsets = column.flatten(), np.asarray(column.offsets) - column.offsets[0].as_py()
    # flatten() leaves out what null rows cover; their offsets are equal in what Spark sends
    value = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    out: list[np.ndarray | None] = []
    for i, ok in enumerate(column.is_valid().to_pylist()):
        v = value[offsets[i] : offsets[i + 1]]
        out.append(v if ok and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _pack(batches):
    """(id, vector) -> (id, dim, two hashes, vector as bytes), usable vectors with an id only."""
    import hashlib

    for batch in batches:
        rows = [(i, len(v), v.tobytes()) for i, v in zip(batch.column(0).to_pylist(), _vectors(batch.column(1)), strict=True) if v is not None and i is not None]
        marks = [np.frombuffer(hashlib.blake2b(x, digest_size=16).digest(), np.int64) for _, _, x in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["vec_id", "dim", "h1", "h2", "raw"])


def _stack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _farthest(x: np.ndarray, k: int) -> np.ndarray:
    """k rows of x, each the farthest from those before."""
    chosen = [0]
    d = _distances(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)) and d.max() > 1e-6:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _assign(centres: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            raw = batch.column(4)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = _unit(_stack(raw.take(pa.array(own)), int(dim)))
                c = centres.get(int(dim))
                if c is None:  # a dimension without a row in the sample is one cell
                    far[own] = 2.0
                    continue
                d = _distances(x, c)
                cell[own] = d.argmin(axis=1)
                far[own] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(far), batch.column(5), raw], names=["vec_id", "dim", "cell", "far", "many", "raw"])

    return run


def _build(table: pa.Table) -> pa.Table:
    """A block's vectors -> one row: ids, multiplicities, vectors and tree."""
    table = table.sort_by("vec_id")
    dim = table.column("dim")[0].as_py()
    x = _unit(_stack(table.column("raw"), dim))
    tree = pickle.dumps((table.column("vec_id").to_numpy(), table.column("many").to_numpy(), x, CoverTree(x)), protocol=5)
    return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([table.column("cell")[0].as_py()], pa.int32()), "sub": pa.array([table.column("sub")[0].as_py()], pa.int32()), "tree": pa.array([tree], pa.binary())})


def _meet(least: float):
    """The blocks of two tiles (rows with first or second true, both for a tile with itself) -> link counts and forests."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("sub", "ascending")])
        parts = [pickle.loads(t) for t in table.column("tree").to_pylist()]
        first, second = (table.column(c).to_numpy() for c in ("first", "second"))
        who, counts, roots = [], [], []
        for i, j in ((i, j) for i in np.flatnonzero(first) for j in np.flatnonzero(second)):
            (ids, many, x, tree), (ids2, many2, y, tree2) = parts[i], parts[j]
            if i == j:
                links = linked(tree, x, tree, x, least)
                links |= links.T
                np.fill_diagonal(links, False)
                count, own, root = links @ many, ids, _forest(links, True)
            elif first[j] and second[i] and i > j:  # a pair of one tile, met before
                continue
            else:
                links = linked(tree, x, tree2, y, least)
                count, own, root = np.concatenate((links @ many2, many @ links)), np.concatenate((ids, ids2)), _forest(links, False)
            found = np.flatnonzero(root >= 0)
            who.append(own[found])
            counts.append(count[found].astype(np.int64))
            roots.append(own[root[found]])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"vec_id": cat(who), "links": cat(counts), "root": cat(roots)})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row: vec_id, n_links (other rows whose vector has a cosine of ``least`` or more), component_id
    (smallest vec_id reachable by links, its own included), kept (vec_id = component_id).

    Null, empty or zero vectors, those with null or non-finite numbers and rows without an id link with nothing (no id:
    component_id null, kept). Vectors of different lengths aren't linked. Repeated rows count as vectors of their own.
    Other columns aren't read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    packed = stash(rows.mapInArrow(_pack, "vec_id long, dim int, h1 long, h2 long, raw binary"))
    reps = stash(packed.groupBy("dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("many")).select(F.col("rep").alias("vec_id"), "dim", "h1", "h2", "raw", "many"))
    total = reps.count()
    sample = reps.select("dim", "raw").orderBy("h1", "h2").limit(SAMPLE).collect()
    centres = {d: _farthest(_unit(np.stack([np.frombuffer(r.raw) for r in sample if r.dim == d])), max(1, min(CELLS, total // CELL_ROWS))) for d in {r.dim for r in sample}}
    dealt = stash(reps.mapInArrow(_assign(centres), "vec_id long, dim int, cell int, far double, many long, raw binary"))
    # CELLS cells for a dimension at most, so this table is bounded by the number of dimensions
    cells = dealt.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + _SLACK
    sizes, meets = {(c.dim, c.cell): c.n for c in cells}, {}
    for p in cells:
        for q in cells:
            if p.dim == q.dim:
                c = centres.get(p.dim)
                gap = 0.0 if c is None else float(np.linalg.norm(c[p.cell] - c[q.cell]))
                if gap <= p.far + q.far + reach:
                    meets.setdefault((p.dim, p.cell), []).append(q.cell)
    # Where no two cells are apart they are one, so that its tiles hold many blocks.
    whole = [d for d in {c.dim for c in cells} if all(len(meets[k]) == sum(e == d for e, _ in sizes) for k in sizes if k[0] == d)]
    for d in whole:
        n = sum(sizes.pop(k) for k in list(sizes) if k[0] == d)
        meets = {k: v for k, v in meets.items() if k[0] != d} | {(d, 0): [0]}
        sizes[d, 0] = n
    dealt = dealt.withColumn("cell", F.when(F.col("dim").isin(whole), 0).otherwise(F.col("cell")))
    subs = {k: math.ceil(n / BLOCK * 1.15) if n > BLOCK else 1 for k, n in sizes.items()}
    tile = {k: min(TILE, max(1, n // LEAST_TILES)) for k, n in subs.items()}
    tiles = {k: math.ceil(n / tile[k]) for k, n in subs.items()}
    plan = spark.createDataFrame([(d, c, subs[d, c], tile[d, c], [(e, tiles[d, e]) for e in sorted(meets[d, c])]) for d, c in subs], "dim int, cell int, subs int, tile int, others array<struct<cell: int, tiles: int>>")
    placed = dealt.join(F.broadcast(plan.select("dim", "cell", "subs")), ["dim", "cell"])
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int"))
    trees = stash(placed.select("dim", "cell", "sub", "vec_id", "many", "raw").groupBy("dim", "cell", "sub").applyInArrow(_build, "dim int, cell int, sub int, tree binary"))
    other = F.explode("others").alias("o")
    mine = F.floor(F.col("sub") / F.col("tile")).cast("int")
    pairs = trees.join(F.broadcast(plan.select("dim", "cell", "tile", "others")), ["dim", "cell"]).select("dim", "cell", "sub", mine.alias("tile"), "tree", other).select("*", F.explode(F.sequence(F.lit(0), F.col("o.tiles") - 1)).alias("t"))
    pairs = pairs.select("dim", "cell", "sub", "tree", F.struct("cell", "tile").alias("mine"), F.struct(F.col("o.cell").alias("cell"), F.col("t").alias("tile")).alias("theirs"))
    task = F.struct("dim", F.least("mine", "theirs").alias("a"), F.greatest("mine", "theirs").alias("b"))
    sent = pairs.select("cell", "sub", "tree", "mine", task.alias("task"))
    sent = sent.select("cell", "sub", "tree", (F.col("mine") == F.col("task.a")).alias("first"), (F.col("mine") == F.col("task.b")).alias("second"), "task")
    met = sent.groupBy("task").applyInArrow(_meet(least), "vec_id long, links long, root long")
    met = stash(met)
    named = components(met.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "vec_id")
    counts = met.groupBy("vec_id").agg(F.sum("links").alias("links"))
    known = reps.drop("raw").join(counts, "vec_id", "left").join(named, "vec_id", "left")
    known = stash(known.select("dim", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    good = packed.select("vec_id", "dim", "h1", "h2").join(known, ["dim", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    bad = rows.where(~_usable("v") | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = good.unionByName(bad)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _usable(col: str):
    """What ``_vectors`` takes, as an expression."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.col(col).isNotNull() & ~F.coalesce(F.exists(col, odd), F.lit(True)) & F.coalesce(F.exists(col, lambda v: v != 0), F.lit(False))
