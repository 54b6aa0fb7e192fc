"""Series and averages cut into runs against the plain loop over all frames, in batch and as a stream with sessions."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import frames
from tessera.operators.frames import FEATURES, FrameState, run_features
from tessera.sources import steps
from tessera.streaming.frame_stream import session_stream

ROWS, COLS = 3, 4


def loop(cells):
    state = FrameState(ROWS, COLS)
    return [state.step(c) for c in cells]


def some(n, seed=0):
    r = np.random.default_rng(seed)
    return [r.random(ROWS * COLS).round(3).tolist() if i % 5 else [0.25] * (ROWS * COLS) for i in range(n)]


@pytest.mark.parametrize("cuts", [[], [1], [1, 2, 3], [7, 8, 20]])
def test_runs_follow_one_another(cuts):
    cells, state, got = some(30), FrameState(ROWS, COLS), []
    for a, b in zip([0, *cuts], [*cuts, 30], strict=True):
        got += run_features(np.array(cells[a:b]).reshape(-1, ROWS, COLS), state).tolist()
    assert np.allclose(got, loop(cells), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("size", [1, 4, 512])
def test_one_stream_is_many_tasks(spark, monkeypatch, size):
    monkeypatch.setattr(frames, "RUN_FRAMES", size)
    rows, want = [], {}
    for s, n in (("long", 23), ("one", 1), ("two", 2), (None, 6)):
        numbers = sorted(random.Random(n).sample(range(-5, 60), n))
        cells = some(n, n)
        rows += [(s, "x" if s != "long" or i < 10 else "y", k, c) for i, (k, c) in enumerate(zip(numbers, cells, strict=True))]
        parts = [(numbers[:10], cells[:10]), (numbers[10:], cells[10:])] if s == "long" else [(numbers, cells)]
        for ns, cs in parts:
            want |= {(s, k): f for k, f in zip(ns, loop(cs), strict=True)}
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id string, session string, frame_number long, cells array<double>").withColumn("run", F.lit("clash"))
    got = frames.feature_series(df, ROWS, COLS, "session").collect()
    assert {(r.stream_id, r.frame_number) for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        assert np.allclose([r[f] for f in FEATURES], want[r.stream_id, r.frame_number], rtol=1e-9, atol=1e-12), (r, want[r.stream_id, r.frame_number])
    assert frames.feature_series(df.limit(0), ROWS, COLS).count() == 0


def test_average_of_a_hot_key(spark, monkeypatch):
    ranged = steps.ranged
    monkeypatch.setattr(steps, "ranged", lambda df, keys: ranged(df, keys, 25))
    r = random.Random(2)
    rows = [(k, t, r.choice([r.random(), None, math.nan])) for k, n in (("hot", 300), ("b", 5), (None, 40), ("empty", 3)) for t in range(n)]
    rows = [(k, t, None if k == "empty" else v) for k, t, v in rows]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(x.k, x.t): x.ema for x in frames.ema(df, 0.3, "k", ["t"], "v").collect()}
    assert len(got) == len(rows)
    for key in ("hot", "b", None, "empty"):
        now = None
        for k, t, v in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            if v is not None and not math.isnan(v):
                now = v if now is None else 0.3 * v + 0.7 * now
            assert (now is None and (got[k, t] is None or math.isnan(got[k, t]))) or math.isclose(got[k, t], now, rel_tol=1e-9)
    assert steps.ranged(df, ["k", "t"]).where("k = 'hot'").select("part").distinct().count() > 2


def test_sessions_of_a_stream_between_micro_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cells = some(12)
    batches = [[("a", "s1", 1), ("a", "s1", 2), ("b", None, 1)], [("a", "s1", 3), ("a", "s2", 4), ("b", None, 2)], [("a", "s2", 5), ("b", None, 1), ("b", None, 3)]]
    (tmp_path / "in").mkdir()
    flat, n = [], 0
    for i, batch in enumerate(batches):
        lines = []
        for s, session, k in batch:
            flat.append((s, session, k, cells[n], i))
            lines.append(json.dumps({"stream_id": s, "session": session, "frame_number": k, "cells": cells[n]}))
            n += 1
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{i}.json", (1_000_000 + i, 1_000_000 + i))  # the source goes by time
    source = spark.readStream.schema("stream_id string, session string, frame_number long, cells array<double>").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    try:
        q = session_stream(source, ROWS, COLS).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = []
    for sessions in ([x for x in flat if x[0] == "a" and x[1] == "s1"], [x for x in flat if x[0] == "a" and x[1] == "s2"], flat[2:3] + flat[5:6], flat[7:9]):
        want += [(x[0], x[2], *f) for x, f in zip(sessions, loop([x[3] for x in sessions]), strict=True)]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert np.allclose(np.array([g[2:] for g in got]), np.array([w[2:] for w in sorted(want)]), rtol=1e-9, atol=1e-12) and [g[:2] for g in got] == [w[:2] for w in sorted(want)]
