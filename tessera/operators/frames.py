"""Frame grids: deltas, energy, blocks, summaries, replay error and the stateful twenty-feature series.

A frame is a row (stream_id, frame_number, cells array<double>), cells row by row of a grid of ``rows`` x ``cols``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources import steps

FEATURES = [
    "energy_total", "energy_mean", "energy_std", "motion_concentration_50", "static_ratio", "center_energy_ratio", "edge_energy_ratio",
    "horizontal_vs_vertical_ratio", "vertical_bias", "tunnel_index", "highfreq_energy", "lowfreq_energy", "high_to_low_ratio", "smoothness_index",
    "stutter_score", "flash_intensity", "focus_ratio", "jitter_band_energy", "contrast_shift_score", "lock_score",
]
_EPS = 1e-8


def cells(frames: DataFrame, cols: int) -> DataFrame:
    """One row for each cell: stream_id, frame_number, r, c, x."""
    rows = frames.select("stream_id", "frame_number", F.posexplode("cells").alias("i", "x"))
    return rows.select("stream_id", "frame_number", F.floor(F.col("i") / cols).cast("int").alias("r"), (F.col("i") % cols).cast("int").alias("c"), F.col("x").cast("double").alias("x"))


def deltas(frames: DataFrame) -> DataFrame:
    """Frames with ``delta``: each cell's absolute change from the frame before; zeros for the first.

    One ``lag`` over frames and arrays zipped cell by cell, instead of a window over every cell.
    """
    before = F.lag("cells").over(W.partitionBy("stream_id").orderBy("frame_number"))
    rows = frames.withColumn("__b", F.coalesce(before, F.col("cells")))
    return rows.withColumn("delta", F.zip_with("cells", "__b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))).drop("__b")


def energy(frames: DataFrame, static: float = 0.01) -> DataFrame:
    """Total, mean, population deviation, share of cells for half the energy, share of still cells of each delta."""
    d = F.col("delta")
    n = F.size(d)
    zero = F.lit(0.0)
    total = F.aggregate(d, zero, lambda a, x: a + x)
    rows = deltas(frames).withColumns({"energy_total": total, "n": n})
    mean = F.col("energy_total") / F.col("n")
    var = F.aggregate(d, zero, lambda a, x: a + (x - mean) * (x - mean)) / F.col("n")
    start = F.struct(zero.alias("s"), F.lit(0).alias("k"))
    half = F.aggregate(F.reverse(F.array_sort(d)), start, lambda a, x: F.struct((a.s + x).alias("s"), (a.k + F.when(a.s < F.col("energy_total") * 0.5, 1).otherwise(0)).alias("k")), lambda a: a.k)
    still = F.size(F.filter(d, lambda x: x < static)) / F.col("n")
    return rows.select("stream_id", "frame_number", "energy_total", mean.alias("energy_mean"), F.sqrt(var).alias("energy_std"), F.when(F.col("energy_total") > _EPS, half / F.col("n")).otherwise(0.0).alias("motion_concentration_50"), still.alias("static_ratio"))


def blocks(frames: DataFrame, cols: int, k: int) -> DataFrame:
    """Mean of each k x k block of the grid."""
    own = cells(frames, cols).groupBy("stream_id", "frame_number", F.floor(F.col("r") / k).alias("br"), F.floor(F.col("c") / k).alias("bc"))
    return own.agg(F.avg("x").alias("mean"))


def clean_vector(frames: DataFrame, col: str = "cells") -> DataFrame:
    """NaN and infinities become null; ``screen_energy`` is the sum of the rest."""
    good = F.transform(col, lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
    return frames.withColumn(col, good).withColumn("screen_energy", F.aggregate(F.col(col), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))


def replay_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean and largest absolute and root mean square difference of frames of the same number."""
    both = a.select("stream_id", "frame_number", F.col("cells").alias("x")).join(b.select("stream_id", "frame_number", F.col("cells").alias("y")), ["stream_id", "frame_number"])
    d = both.select("stream_id", "frame_number", F.explode(F.zip_with("x", "y", lambda x, y: x.cast("double") - y.cast("double"))).alias("d"))
    return d.groupBy("stream_id", "frame_number").agg(F.avg(F.abs("d")).alias("mae"), F.max(F.abs("d")).alias("max_error"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))


def chunks(frames: DataFrame, size: int) -> DataFrame:
    """Frames numbered into chunks of ``size``."""
    r = F.row_number().over(W.partitionBy("stream_id").orderBy("frame_number"))
    return frames.withColumn("chunk_id", F.floor((r - 1) / size).cast("long"))


def upsample(frames: DataFrame, rows: int, cols: int, factor: int) -> DataFrame:
    """Each cell repeated factor x factor times (nearest neighbour)."""
    i = F.sequence(F.lit(0), F.lit(rows * factor * cols * factor - 1))
    at = lambda p: (F.floor(F.floor(p / (cols * factor)) / factor) * cols + F.floor((p % (cols * factor)) / factor)).cast("int")
    return frames.withColumn("cells", F.transform(i, lambda p: F.get("cells", at(p))))


def summary(series: DataFrame, features: list[str]) -> DataFrame:
    """feature, low, high, mean, n; NaN counts as missing."""
    pairs = ", ".join(f"'{f}', {f}" for f in features)
    flat = series.select(F.expr(f"stack({len(features)}, {pairs}) as (feature, x)")).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return flat.groupBy("feature").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.count("x").alias("n"))


def ema(events: DataFrame, alpha: float, key: str, order: list[str], value: str) -> DataFrame:
    """Exponential moving average of a value along each key's rows: first = the value itself; null and NaN values leave it as it is.

    The average after some rows is a * (average before) + b, with a and b from these rows alone. So rows are dealt by ranges of
    (key, order); each run of a key gives its (a, b), the runs are put together in order, and each run starts from what came
    before. A key of any size is as many tasks as it has ranges. A null key is a key like another; equal rows of ``order`` have no
    order among them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    slim = steps.ranged(events.select(key, *order, value), [key, *order])
    kept = [key, *order, value]

    def laid(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values([key, *order], kind="stable", na_position="first")
        return pdf, pd.factorize(pdf[key], use_na_sentinel=False)[0]

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, code = laid(pdf)
        rows = []
        for c in dict.fromkeys((code[0], code[-1])):  # only the keys at either end of a range can go on in another
            own = pdf[code == c]
            x = own[value].to_numpy(float)
            x = x[~np.isnan(x)]
            weights = alpha * (1 - alpha) ** np.arange(len(x) - 1, -1, -1)
            rows.append(own[[key, "part"]].iloc[:1].assign(head=c == code[0], a=(1 - alpha) ** len(x), b=float(weights @ x), first=x[0] if len(x) else np.nan))
        return pd.concat(rows)

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = object(), np.nan
        for pdf in batches:
            before = np.full(len(pdf), np.nan)
            for i, (k, a, b, first) in enumerate(zip(pdf[key], pdf["a"], pdf["b"], pdf["first"], strict=True)):
                if not (k == last or (pd.isna(k) and pd.isna(last))):
                    last, now = k, np.nan
                before[i] = now
                now = now if np.isnan(first) else a * (first if np.isnan(now) else now) + b
            yield pdf[["part", "head"]].assign(before=before)

    def run(own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        own, code = laid(own)
        x = pd.Series(np.concatenate([state["before"].to_numpy(float)[:1], own[value].to_numpy(float)]))
        averaged = x.groupby(np.concatenate([code[:1], code])).ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
        return own[kept].assign(ema=averaged.to_numpy()[1:])

    runs = slim.groupBy("part").applyInPandas(told, f"{key} {kinds[key]}, part int, head boolean, a double, b double, first double")
    states = runs.repartition(key).sortWithinPartitions(key, "part").mapInPandas(carried, "part int, head boolean, before double").where("head")
    return slim.groupBy("part").cogroup(states.groupBy("part")).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", ema double")


@dataclass
class FrameState:
    """State of one stream: the frame before, a fast and a slow moving average, the energy before."""

    rows: int
    cols: int
    fast: float = 0.3
    slow: float = 0.1
    static: float = 0.01
    flash: float = 0.3
    before: np.ndarray | None = None
    ema_fast: np.ndarray | None = None
    ema_slow: np.ndarray | None = None
    energy: float = 0.0
    center: np.ndarray = field(init=False)
    edge: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (self.rows, self.cols)
        self.center, self.edge = np.zeros(shape, bool), np.ones(shape, bool)
        h, w = (max(1, min(n, round(n * 0.4))) for n in shape)
        top, left = (self.rows - h) // 2, (self.cols - w) // 2
        self.center[top : top + h, left : left + w] = True
        self.edge[1:-1, 1:-1] = False

    def step(self, values: list[float]) -> list[float]:
        """The twenty features of the next frame; constants for the first, which leaves the energy at 0."""
        x = np.asarray(values, float).reshape(self.rows, self.cols)
        if self.before is None:
            self.before = self.ema_fast = self.ema_slow = x
            still = {"static_ratio", "horizontal_vs_vertical_ratio", "smoothness_index"}
            return [1.0 if f in still else 0.0 for f in FEATURES]
        self.ema_fast = self.fast * x + (1 - self.fast) * self.ema_fast
        self.ema_slow = self.slow * x + (1 - self.slow) * self.ema_slow
        d, high, low = np.abs(x - self.before), np.abs(x - self.ema_slow), np.abs(self.ema_fast - self.ema_slow)
        total, std, peak = d.sum(), d.std(), d.max()
        run = np.cumsum(np.sort(d, axis=None)[::-1])
        half = (np.searchsorted(run, 0.5 * run[-1]) + 1) / d.size if run[-1] > _EPS else 0.0
        center, mid = d[self.center].sum(), self.rows // 2
        edge_var, center_var = x[self.edge].var(), x[self.center].var()
        share, smooth = center / (total + _EPS), 1 / (1 + std)
        swing = abs(total - self.energy) / (self.energy + _EPS) if abs(self.energy) > _EPS else 0.0
        across, down = np.abs(np.diff(d, axis=1)).sum(), np.abs(np.diff(d, axis=0)).sum()
        out = [
            total, d.mean(), std, half, (d < self.static).mean(), share, d[self.edge].sum() / (total + _EPS), across / (down + _EPS),
            (d[:mid].sum() - d[mid:].sum()) / (total + _EPS), (edge_var - center_var) / (edge_var + center_var + _EPS), high.sum(), low.sum(),
            high.sum() / (low.sum() + _EPS), smooth, swing, peak, share if peak > self.flash else 0.0, abs(high[self.center].sum() - center),
            abs(x.var() - self.ema_slow.var()), share * smooth * (1 - min(1.0, high.sum() / 10)),
        ]
        self.before, self.energy = x, total
        return [float(v) for v in out]

    def dump(self) -> tuple[list[float], list[float], list[float], float]:
        return tuple([] if a is None else a.reshape(-1).tolist() for a in (self.before, self.ema_fast, self.ema_slow)) + (float(self.energy),)

    def load(self, before, fast, slow, energy) -> FrameState:
        shape = (self.rows, self.cols)
        if len(before):
            self.before, self.ema_fast, self.ema_slow = (np.asarray(a, float).reshape(shape) for a in (before, fast, slow))
        self.energy = energy
        return self


SERIES = "stream_id string, frame_number long, " + ", ".join(f"{f} double" for f in FEATURES)


#: Frames of a run at most: what one task holds of a stream.
RUN_FRAMES = 512


def run_features(x: np.ndarray, state: FrameState) -> np.ndarray:
    """The twenty features of consecutive frames (n, rows, cols) after ``state``, all frames of the run at once; only the two
    averages go from frame to frame. Leaves ``state`` behind the run."""
    new = state.before is None
    if new:
        state.step(x[0].reshape(-1).tolist())
    y = x[1:] if new else x
    fast, slow = np.empty_like(y), np.empty_like(y)
    f, s = state.ema_fast, state.ema_slow
    for i in range(len(y)):
        f = fast[i] = state.fast * y[i] + (1 - state.fast) * f
        s = slow[i] = state.slow * y[i] + (1 - state.slow) * s
    out = np.zeros((len(x), len(FEATURES)))
    if new:
        out[0, [FEATURES.index(c) for c in ("static_ratio", "horizontal_vs_vertical_ratio", "smoothness_index")]] = 1.0
    row = lambda a: np.ascontiguousarray(a.reshape(len(y), -1))  # noqa: E731  sums by frame don't depend on how many frames there are
    if len(y):
        d = np.abs(np.diff(np.concatenate([state.before[None], y]), axis=0))
        high, low, flat = np.abs(y - slow), np.abs(fast - slow), d.reshape(len(y), -1)
        total, std, peak = flat.sum(axis=1), flat.std(axis=1), flat.max(axis=1)
        heap = np.cumsum(-np.sort(-flat, axis=1), axis=1)
        half = np.where(heap[:, -1] > _EPS, ((heap < 0.5 * heap[:, -1:]).sum(axis=1) + 1) / flat.shape[1], 0.0)
        center, mid = row(d[:, state.center]).sum(axis=1), state.rows // 2
        edge_var, center_var = row(y[:, state.edge]).var(axis=1), row(y[:, state.center]).var(axis=1)
        share, smooth = center / (total + _EPS), 1 / (1 + std)
        before = np.concatenate([[state.energy], total[:-1]])
        swing = np.where(np.abs(before) > _EPS, np.abs(total - before) / (before + _EPS), 0.0)
        across, down = row(np.abs(np.diff(d, axis=2))).sum(axis=1), row(np.abs(np.diff(d, axis=1))).sum(axis=1)
        highs, lows = row(high).sum(axis=1), row(low).sum(axis=1)
        out[int(new) :] = np.column_stack([
            total, flat.mean(axis=1), std, half, (flat < state.static).mean(axis=1), share, row(d[:, state.edge]).sum(axis=1) / (total + _EPS), across / (down + _EPS),
            (row(d[:, :mid]).sum(axis=1) - row(d[:, mid:]).sum(axis=1)) / (total + _EPS), (edge_var - center_var) / (edge_var + center_var + _EPS), highs, lows,
            highs / (lows + _EPS), smooth, swing, peak, np.where(peak > state.flash, share, 0.0), np.abs(row(high[:, state.center]).sum(axis=1) - center),
            np.abs(row(y).var(axis=1) - row(slow).var(axis=1)), share * smooth * (1 - np.minimum(1.0, highs / 10)),
        ])
        state.before, state.ema_fast, state.ema_slow, state.energy = y[-1], f, s, float(total[-1])
    return out


_STATE = "before array<double>, fast array<double>, slow array<double>, energy double"


def feature_series(frames: DataFrame, rows: int, cols: int, session_col: str | None = None) -> DataFrame:
    """The twenty features of every frame of every stream, in order of frame numbers; the state starts anew with each session
    of a stream, where ``session_col`` names one.

    A stream is cut into runs of RUN_FRAMES frame numbers. What a run does to the averages is an affine map that follows from
    its frames alone; the maps of a stream's runs are put together in order (a small row a run, one at a time), and every
    run then goes on from its own start, so a recording of any length is as many tasks as it has runs.
    """
    session = F.col(session_col).cast("string") if session_col else F.lit(None).cast("string")
    slim = frames.select(F.col("stream_id").cast("string").alias("stream_id"), session.alias("session"), F.col("frame_number").cast("long").alias("frame_number"), F.col("cells").cast("array<double>").alias("cells"))
    slim = slim.withColumn("run", F.floor(F.col("frame_number") / RUN_FRAMES))
    key = ["stream_id", "session", "run"]
    grid = lambda pdf: np.stack([np.asarray(c, float).reshape(rows, cols) for c in pdf.sort_values("frame_number", kind="stable")["cells"]])
    flat = lambda a: np.asarray(a, float).reshape(-1)

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        x, blank = grid(pdf), FrameState(rows, cols)
        n = len(x)
        sums = [np.tensordot(al * (1 - al) ** np.arange(n - 1, -1, -1), x, 1).reshape(-1) for al in (blank.fast, blank.slow)]
        row = pdf[key].iloc[:1].reset_index(drop=True)
        return row.assign(n=n, fast=[sums[0]], slow=[sums[1]], first=[flat(x[0])], last=[flat(x[-1])], energy=float(np.abs(x[-1] - x[-2]).sum()) if n > 1 else np.nan)

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, now, blank = None, None, FrameState(rows, cols)
        same = lambda a, b: a == b or (pd.isna(a) and pd.isna(b))
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if of is None or not (same(of[0], r.stream_id) and same(of[1], r.session)):
                    of, now = (r.stream_id, r.session), None
                out.append([r.stream_id, r.session, r.run, *(now or ([], [], [], 0.0))])
                start = now or (None, r.first, r.first, 0.0)
                averages = [(1 - al) ** r.n * np.asarray(e, float) + np.asarray(b, float) for al, e, b in ((blank.fast, start[1], r.fast), (blank.slow, start[2], r.slow))]
                alone = float(np.abs(np.asarray(r.last) - np.asarray(start[0])).sum()) if start[0] is not None else 0.0
                now = (list(r.last), averages[0].tolist(), averages[1].tolist(), alone if np.isnan(r.energy) else r.energy)
            yield pd.DataFrame(out, columns=[*key, "before", "fast", "slow", "energy"])

    def run(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        state = FrameState(rows, cols).load(*(start[c].iloc[0] for c in ("before", "fast", "slow", "energy")))
        out = pd.DataFrame(run_features(grid(own), state), columns=FEATURES)
        own = own.sort_values("frame_number", kind="stable").reset_index(drop=True)
        out.insert(0, "stream_id", own["stream_id"])
        out.insert(1, "frame_number", own["frame_number"])
        return out

    where = "stream_id string, session string, run long"
    cells_of = "array<double>"
    runs = slim.groupBy(*key).applyInPandas(told, f"{where}, n long, fast {cells_of}, slow {cells_of}, first {cells_of}, last {cells_of}, energy double")
    starts = runs.repartition("stream_id", "session").sortWithinPartitions(*key).mapInPandas(carried, f"{where}, {_STATE}")
    return slim.groupBy(*key).cogroup(starts.groupBy(*key)).applyInPandas(run, SERIES)


def spatial(frames: DataFrame, rows: int, cols: int) -> DataFrame:
    """Shares of the change in the centre and on the border, gradient ratio, upper less lower half, and the border's
    variance against the centre's."""
    h, w = (max(1, min(n, round(n * 0.4))) for n in (rows, cols))
    top, left = (rows - h) // 2, (cols - w) // 2
    r, c, x, d = (F.col(k) for k in "rcxd")
    at = deltas(frames).select("stream_id", "frame_number", F.posexplode(F.arrays_zip(F.col("cells").alias("x"), F.col("delta").alias("d"), F.slice(F.concat("delta", F.array(F.lit(None).cast("double"))), 2, rows * cols).alias("right"), F.slice(F.concat("delta", F.array_repeat(F.lit(None).cast("double"), cols)), cols + 1, rows * cols).alias("below"))).alias("i", "v"))
    own = at.select("stream_id", "frame_number", F.floor(F.col("i") / cols).cast("int").alias("r"), (F.col("i") % cols).cast("int").alias("c"), F.col("v.x").cast("double").alias("x"), F.col("v.d").alias("d"), F.col("v.right").alias("right"), F.col("v.below").alias("below"))
    centre = (r >= top) & (r < top + h) & (c >= left) & (c < left + w)
    edge = r.isin(0, rows - 1) | c.isin(0, cols - 1)
    some = lambda test, v: F.coalesce(F.sum(F.when(test, v)), F.lit(0.0))
    got = own.groupBy("stream_id", "frame_number").agg(
        F.sum(d).alias("t"), some(centre, d).alias("ce"), some(edge, d).alias("ed"), some(r < rows // 2, d).alias("up"), some(r >= rows // 2, d).alias("lo"),
        some(c < cols - 1, F.abs(F.col("right") - d)).alias("across"), F.coalesce(F.sum(F.abs(F.col("below") - d)), F.lit(0.0)).alias("down"),
        F.var_pop(F.when(edge, x)).alias("ev"), F.var_pop(F.when(centre, x)).alias("cv"),
    )
    t = F.col("t") + _EPS
    return got.select(
        "stream_id", "frame_number", (F.col("ce") / t).alias("center_energy_ratio"), (F.col("ed") / t).alias("edge_energy_ratio"), (F.col("across") / (F.col("down") + _EPS)).alias("horizontal_vs_vertical_ratio"),
        ((F.col("up") - F.col("lo")) / t).alias("vertical_bias"), ((F.col("ev") - F.col("cv")) / (F.col("ev") + F.col("cv") + _EPS)).alias("tunnel_index"),
    )


def resized(frames: DataFrame, rows: int, cols: int, new_rows: int, new_cols: int) -> DataFrame:
    """stream_id, frame_number, r, c, x: the grid on another raster, each new cell the mean of what it covers by area."""
    fy, fx = rows / new_rows, cols / new_cols
    own = cells(frames, cols)
    hits = lambda n, f, high: F.sequence(F.floor(F.col(n) / f).cast("int"), F.least(F.lit(high - 1), F.ceil((F.col(n) + 1) / f).cast("int") - 1))
    met = own.withColumn("nr", F.explode(hits("r", fy, new_rows))).withColumn("nc", F.explode(hits("c", fx, new_cols)))
    part = lambda old, new, f: F.greatest(F.lit(0.0), F.least(F.col(old) + 1, (F.col(new) + 1) * f) - F.greatest(F.col(old).cast("double"), F.col(new) * f))
    area = part("r", "nr", fy) * part("c", "nc", fx)
    return met.withColumn("a", area).groupBy("stream_id", "frame_number", F.col("nr").alias("r"), F.col("nc").alias("c")).agg((F.sum(F.col("x") * F.col("a")) / F.sum("a")).alias("x"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h, s, v> of 0..255 channels: hue in half degrees, saturation and value to 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(span == 0, 0.0).when(top == r, (g - b) / span * 30).when(top == g, (b - r) / span * 30 + 60).otherwise((r - g) / span * 30 + 120)
    return F.struct(F.when(hue < 0, hue + 180).otherwise(hue).alias("h"), F.when(top == 0, 0.0).otherwise(span / top * 255.0).alias("s"), top.cast("double").alias("v"))


def cell_features(pixels: DataFrame, k: int) -> DataFrame:
    """Pixels (stream_id, frame_number, r, c, red, green, blue) -> each k x k cell's means and deviations of the channels,
    means of hue, saturation and value, mean and deviation of luma, and luma's change from the cell in the frame before."""
    grey, tone = luma(F.col("red"), F.col("green"), F.col("blue")), hsv(F.col("red"), F.col("green"), F.col("blue"))
    own = pixels.withColumns({"luma": grey, "t": tone}).groupBy("stream_id", "frame_number", F.floor(F.col("r") / k).alias("cr"), F.floor(F.col("c") / k).alias("cc"))
    stats = [f(c).alias(f"{c}_{n}") for c in ("red", "green", "blue", "luma") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    got = own.agg(*stats, *(F.avg(f"t.{x}").alias(f"{n}_mean") for x, n in (("h", "hue"), ("s", "saturation"), ("v", "value"))))
    before = F.lag("luma_mean").over(W.partitionBy("stream_id", "cr", "cc").orderBy("frame_number"))
    return got.withColumn("delta_luma", F.abs(F.col("luma_mean") - F.coalesce(before, F.col("luma_mean"))))


def scene_resonance(cells_of: DataFrame, blocks_of: DataFrame, block_rows: int, block_cols: int) -> DataFrame:
    """Nine figures of a frame from its cells (luma, motion, edge, texture) and the motion of its blocks (br, bc, mean)."""
    mid = (F.col("br") >= block_rows // 3) & (F.col("br") < block_rows * 2 // 3) & (F.col("bc") >= block_cols // 3) & (F.col("bc") < block_cols * 2 // 3)
    b = blocks_of.groupBy("stream_id", "frame_number").agg(F.sum("mean").alias("total"), F.avg("mean").alias("energy_mean"), F.stddev_pop("mean").alias("energy_std"), F.coalesce(F.sum(F.when(mid, F.col("mean"))), F.lit(0.0)).alias("centre"), (F.max("mean") - F.avg("mean")).alias("stutter"))
    c = cells_of.groupBy("stream_id", "frame_number").agg((F.max("luma") / 255.0).alias("flash"), F.avg((F.col("motion") <= 0.001).cast("int")).alias("static_ratio"), F.sum("edge").alias("highfreq"), F.avg("texture").alias("lowfreq"))
    return b.join(c, ["stream_id", "frame_number"]).select("stream_id", "frame_number", F.col("total").alias("energy_total"), "energy_mean", "energy_std", F.when(F.col("total") != 0, F.col("centre") / F.col("total")).otherwise(0.0).alias("center_energy_ratio"), "flash", "static_ratio", "highfreq", "lowfreq", "stutter")
