"""The frame series as a stream: one state a stream of frames, kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.frames import _STATE, FEATURES, SERIES, FrameState, run_features


def feature_stream(frames: DataFrame, rows: int, cols: int) -> DataFrame:
    """As ``feature_series`` on a streaming frame source; frames of a stream must arrive in order of micro-batches."""
    slim = frames.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("frame_number").cast("long").alias("frame_number"), F.col("cells").cast("array<double>").alias("cells"))

    def run(key, batches, state: GroupState):
        own = FrameState(rows, cols)
        if state.exists:
            own.load(*state.get)
        pdf = pd.concat(list(batches)).sort_values("frame_number")
        out = pd.DataFrame(run_features(np.stack([np.asarray(x, float).reshape(rows, cols) for x in pdf["cells"]]), own), columns=FEATURES)
        state.update(own.dump())
        out.insert(0, "stream_id", key[0])
        out.insert(1, "frame_number", pdf["frame_number"].to_numpy())
        yield out

    return slim.groupBy("stream_id").applyInPandasWithState(run, SERIES, _STATE, "append", GroupStateTimeout.NoTimeout)


class SessionFrames(StatefulProcessor):
    """State of a stream's running session; a frame of another session, or one whose number isn't above the last one's, starts anew."""

    def __init__(self, rows: int, cols: int):
        self.rows, self.cols = rows, cols

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("frames", f"{_STATE}, session string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, session, last = FrameState(self.rows, self.cols), None, None
        if self.state.exists():
            *held, session, last = self.state.get()
            own.load(*held)
        pdf = pd.concat(list(rows)).sort_values(["arrived", "frame_number"], kind="stable")
        sessions, numbers = [None if pd.isna(x) else x for x in pdf["session"]], pdf["frame_number"].tolist()
        cuts = [i for i in range(len(numbers)) if (sessions[i], True) != ((sessions[i - 1], numbers[i] > numbers[i - 1]) if i else (session, last is not None and numbers[i] > last))]
        for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
            if b > a:
                if a in cuts:
                    own = FrameState(self.rows, self.cols)
                grid = np.stack([np.asarray(c, float).reshape(self.rows, self.cols) for c in pdf["cells"].iloc[a:b]])
                out = pd.DataFrame(run_features(grid, own), columns=FEATURES)
                out.insert(0, "stream_id", key[0])
                out.insert(1, "frame_number", numbers[a:b])
                yield out
        self.state.update((*own.dump(), sessions[-1], numbers[-1]))

    def close(self) -> None:
        pass


def session_stream(frames: DataFrame, rows: int, cols: int, session_col: str = "session", time_col: str | None = None) -> DataFrame:
    """The series on a streaming source with the state reset between sessions. Frames of a micro-batch go by ``time_col`` and
    number, micro-batches one after another. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    when = F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")
    slim = frames.select(
        F.col("stream_id").cast("string").alias("stream_id"), F.col(session_col).cast("string").alias("session"), when.alias("arrived"), F.col("frame_number").cast("long").alias("frame_number"),
        F.col("cells").cast("array<double>").alias("cells"),
    )
    return slim.groupBy("stream_id").transformWithStateInPandas(SessionFrames(rows, cols), SERIES, "append", "None")


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key, with a watermark for late rows."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
