"""Structured Streaming: windowed bars and the recursive filters as stateful operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratabar.operators.online import cusum_step, trend_start, trend_step


def tumbling_bars(events: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(event_type, start, n, sum_value, max_value, min_value) per window; on a stream, rows later than ``late`` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy("event_type", span.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("sum_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "sum_value", "max_value", "min_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, sum_value) of each user's sessions."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("sum_value"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "sum_value")


CUSUM_OUT = "key string, ts timestamp, z double, declared int, evidence double"
CUSUM_STATE = "up double, down double, declared int"


def cusum(rows: DataFrame, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Two-sided CUSUM of ``z`` per ``key``, three numbers of state a key; rows of a micro-batch are taken in order of ts."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0.0, 0.0, 1)
        held = (held[0], held[1], int(held[2]))
        got = [f for f in frames if len(f)]
        if not got:
            return
        frame = pd.concat(got).sort_values("ts", kind="stable")
        declared, evidence = [], []
        for z in frame["z"]:
            held, e = cusum_step(held, float(z), k, h)
            declared.append(held[2])
            evidence.append(e)
        state.update(held)
        yield pd.DataFrame({"key": frame["key"], "ts": frame["ts"], "z": frame["z"], "declared": pd.Series(declared, index=frame.index, dtype="int32"), "evidence": evidence})

    return rows.select("key", "ts", "z").groupBy("key").applyInPandasWithState(step, CUSUM_OUT, CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)


TREND_OUT = "key string, ts timestamp, y double, level double, slope double"
TREND_STATE = "level double, slope double, a double, b double, c double"


def trend(rows: DataFrame, q_level: float = 1e-5, q_slope: float = 1e-8, r: float = 1e-4) -> DataFrame:
    """Local linear trend of ``y`` per ``key``, five numbers of state a key."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        got = [f for f in frames if len(f)]
        if not got:
            return
        frame = pd.concat(got).sort_values("ts", kind="stable")
        levels, slopes = [], []
        for y in frame["y"]:
            held = trend_start(float(y)) if held is None else held
            held, _, _ = trend_step(held, float(y), q_level, q_slope, r)
            levels.append(held[0])
            slopes.append(held[1])
        state.update(tuple(float(x) for x in held))
        yield pd.DataFrame({"key": frame["key"], "ts": frame["ts"], "y": frame["y"], "level": levels, "slope": slopes})

    return rows.select("key", "ts", "y").groupBy("key").applyInPandasWithState(step, TREND_OUT, TREND_STATE, "append", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, name: str) -> DataFrame:
    """Drive a file-fed stream to its end into a Parquet table beside its checkpoint, and read that.

    Both lie in the shared folder ``spark.checkpoint.dir``; only a session on
    one machine, where it may be unset, gets a temporary folder.
    """
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="stratabar-")
    base = f"{root.rstrip('/')}/stratabar/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)  # a stream without rows writes nothing
    files.deleteOnExit(path.getParent())
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
