"""A Merkle manifest of a data set: one tree for each group of rows, one over the groups' roots, and a proof for each row.

Nodes climb as events. In a task a partial parent gathers the digests of its children by place until it has as many as the
size of its level says (the last run of a level may be short), then it is a child itself and climbs on. The rows of a group
lie in ranges, so nearly all parents are met where the leaves are; what stays unresolved, a few nodes for each side and level
of a run, is dealt anew by ever larger subtrees until each group has one node. Proofs come down the same way back: a task
gets its nodes and the paths of those it had sent on, and gives each node its siblings and its parent's path. No task holds
more than a range of leaves or a stated number of frontier nodes, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.places import placed
from tessera.llm.store import small_batches, stash

#: A round resolves subtrees this many levels higher than the one before; the first, so many above a run of leaves.
LEVELS, FIRST_LEVELS = 5, 3

NODE = "grp string, came long, n long, level int, idx long, digest string"
PATH = "grp string, came long, level int, idx long, subroot string, root string, path array<string>"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 over the values, each `-` if null, else the bytes of its text, `:` and the text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Climb:
    """The nodes of one group that meet in a task."""

    def __init__(self, n: int, arity: int):
        self.arity, self.sizes = arity, [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // arity))
        self.waiting: dict[tuple[int, int], dict[int, str]] = {}
        self.met: dict[tuple[int, int], list[str]] = {}
        self.top: str | None = None

    def event(self, level: int, i: int, digest: str) -> None:
        """A node that is there: complete parents follow at once."""
        while self.sizes[level] > 1:
            key, place = (level + 1, i // self.arity), i % self.arity
            children = self.waiting.setdefault(key, {})
            children[place] = digest
            if len(children) < min(self.arity, self.sizes[level] - self.arity * key[1]):
                return
            del self.waiting[key]
            run = self.met[key] = [children[p] for p in range(len(children))]
            level, i, digest = *key, hashlib.sha256("".join(run).encode()).hexdigest()
        self.top = digest

    def frontier(self) -> list[tuple[int, int, str]]:
        """(level, place, digest) of the nodes whose parents lack children, and of the group's root if it is met."""
        out = [(level - 1, p * self.arity + place, d) for (level, p), children in self.waiting.items() for place, d in children.items()]
        return out + ([(len(self.sizes) - 1, 0, self.top)] if self.top is not None else [])

    def path(self, level: int, i: int, above: dict[tuple[int, int], list[str]]) -> list[str]:
        """For each level from the node up: its place in its run, then the others' digests. ``above``: paths that are known."""
        if (level, i) not in above:
            run, place = self.met[level + 1, i // self.arity], i % self.arity
            above[level, i] = [str(place) + "".join(run[:place] + run[place + 1 :]), *self.path(level + 1, i // self.arity, above)]
        return above[level, i]


def _climb(table: pa.Table, arity: int) -> Climb:
    c = Climb(table.column("n")[0].as_py(), arity)
    for level, i, d in zip(*(table.column(x).to_pylist() for x in ("level", "idx", "digest")), strict=True):
        c.event(level, i, d)
    return c


def _up(arity: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(_climb(table, arity).frontier())
        level, idx, d = zip(*rows, strict=True)
        one = lambda x, kind: pa.array([table.column(x)[0].as_py()] * len(rows), kind)
        return pa.table([one("grp", pa.string()), one("home", pa.int64()), one("n", pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(d, pa.string())], names=["grp", "came", "n", "level", "idx", "digest"])

    return run


def _down(arity: int, keep: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        above = dict(zip(zip(right.column("level").to_pylist(), right.column("idx").to_pylist(), strict=True), right.column("path").to_pylist(), strict=True))
        c, n = _climb(left, arity), left.num_rows
        paths = [c.path(level, i, above) for level, i in zip(left.column("level").to_pylist(), left.column("idx").to_pylist(), strict=True)]
        one = lambda x: pa.array([right.column(x)[0].as_py()] * n, pa.string())
        return pa.table([*[left.column(x) for x in keep], one("subroot"), one("root"), pa.array(paths, pa.list_(pa.string()))], names=[*keep, "subroot", "root", "path"])

    return run


def _rounds(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """Tables of nodes with (grp, home): the leaves, then what each round left unresolved; the last holds the roots."""
    of = leaves.groupBy("grp", "home").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("c")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("runs"), F.sum("c").alias("c")).first()
    high = lambda n: math.ceil(math.log(max(n or 1, 1), arity) - 1e-9)
    up = lambda nodes, h: stash(nodes.groupBy("grp", "home").applyInArrow(_up(arity), NODE).withColumn("home", F.expr(f"idx div cast(pow({arity}, greatest({h} - level, 0)) as bigint)")))
    h = high((of.c or 1) / max(of.runs, 1)) + FIRST_LEVELS
    tables = [leaves, up(leaves, h)]
    while True:
        met, h = h, h + LEVELS
        tables.append(up(tables[-1], h))
        if met >= high(of.n):
            return tables


def _paths(tables: list[DataFrame], roots: DataFrame, arity: int, keep: list[str]) -> DataFrame:
    """From the paths of the last table's nodes those of the first one's, with the columns ``keep`` of that."""
    paths = roots
    for k in range(len(tables) - 2, -1, -1):
        own = keep if k == 0 else ["grp", "came", "level", "idx"]
        kinds = {f.name: f.dataType.simpleString() for f in tables[k].schema}
        schema = ", ".join(f"{c} {kinds[c]}" for c in own) + ", subroot string, root string, path array<string>"
        paths = tables[k].groupBy("grp", "home").cogroup(paths.groupBy("grp", "came")).applyInArrow(_down(arity, own), schema)
        if k:
            paths = stash(paths)
    return paths


def manifest(leaves: DataFrame, group_col: str, order_col: str, arity: int = 3) -> DataFrame:
    """The rows of ``leaves`` (a column ``leaf`` of hex digests among them) with subroot, root and path.

    A group's leaves ascend by ``order_col`` (null first; of equal ones by leaf); every ``arity`` (2 to 9) consecutive nodes, at
    the end of a level fewer, become the sha256 of their digests until one is left, the subroot. The subroots, by group (null
    first, by bytes), give root in the same way. path has a text for each level up to root: the place in the run as a digit,
    then the digests of the run's others from left to right. A lone leaf is its subroot. No rows give no rows.
    """
    if not 2 <= arity <= 9:
        raise ValueError("arity is 2 to 9")
    small_batches(leaves.sparkSession)
    rows = stash(leaves.withColumn("grp", F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit(""))))
    keep = leaves.columns
    nodes = stash(placed(rows, "grp", [order_col, "leaf"]).withColumns({"home": F.col("part"), "level": F.lit(0), "digest": F.col("leaf")}).drop("part"))
    low = _rounds(nodes, arity)
    subroots = stash(low[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"))
    high = _rounds(stash(placed(subroots, "grp", ["name"]).withColumns({"home": F.col("part"), "level": F.lit(0)}).drop("part")), arity)
    top = high[-1].select("grp", "came", "level", "idx", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<string>").alias("path"))
    over = stash(_paths(high, top, arity, ["name"]).select("name", "root", "path"))
    ends = low[-1].select("grp", "came", "level", "idx", F.col("digest").alias("subroot")).join(over, F.col("grp") == F.col("name")).select("grp", "came", "level", "idx", "subroot", "root", "path")
    return _paths(low, ends, arity, keep)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""

    def step(d: Column, x: Column) -> Column:
        at = x.substr(F.lit(1), F.lit(1)).cast("int") * 64
        return F.sha2(F.concat(x.substr(F.lit(2), at), d, x.substr(at + 2, F.length(x))), 256)

    return F.aggregate(path, leaf, step)


def siblings_digest(path: Column) -> Column:
    """sha256 of all digests of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda x: x.substr(F.lit(2), F.length(x))), ""), 256)
