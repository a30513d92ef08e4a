"""Structured Streaming counterparts: windowed aggregates with watermarks, sessions, first-seen rows, stateful splitting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def stream_of(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream; what is read at once is bounded by files per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(df: DataFrame, at: str, length: str, keys: list[str], value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window(at, length, slide) if slide else F.window(at, length)
    g = df.withWatermark(at, late).groupBy(w.alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n", "total", "most")


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    g = df.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n", "total")


def first_seen(df: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once; state older than the watermark goes."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def extents(df: DataFrame, at: str, length: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows of each key and window, with the first and last time; extents of several windows add up to a key's mean gap."""
    g = df.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).select(F.col("w.start").alias("start"), *keys, "n", "low", "high")


def demultiplex_stream(df: DataFrame, run: str, cycle: str, window: str, mz: str, intensity: str) -> DataFrame:
    """Split the peaks of overlapping windows by their neighbours' signal, cycle by cycle.  Only the newest cycle of a run
    is held back, since its windows may still arrive; the rest is emitted and forgotten."""
    from peakfold.operators.kernels import demultiplex_factor

    names = [cycle, window, mz, intensity]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([list(x) for x in zip(*state.get)] if state.exists else [], columns=names)
        rows = pd.concat([held, *[p[names] for p in parts]], ignore_index=True)
        last = rows[cycle].max()
        done, rest = rows[rows[cycle] < last], rows[rows[cycle] == last]
        state.update(tuple(rest[c].tolist() for c in names))
        peaks = done.set_index([cycle, window, mz])[intensity]
        below = [peaks.get((c, w - 1, m), 0.0) for c, w, m in peaks.index]
        above = [peaks.get((c, w + 1, m), 0.0) for c, w, m in peaks.index]
        share = demultiplex_factor(pd.Series(below, dtype=float).to_numpy(), pd.Series(above, dtype=float).to_numpy())
        out = done.assign(lower=peaks.to_numpy() * share, upper=peaks.to_numpy() * (1 - share)).dropna()
        out.insert(0, run, k[0])
        yield out[[run, *names, "lower", "upper"]]

    types = dict(df.dtypes)
    out = ", ".join([f"{run} {types[run]}", *[f"{c} {types[c]}" for c in names], "lower double", "upper double"])
    state = ", ".join(f"{c} array<{types[c]}>" for c in names)
    return df.groupBy(run).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, out: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there now into Parquet (or memory for modes that Parquet lacks) and return the rows."""
    import uuid

    spark = df.sparkSession
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or f"{out}-state").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    name = "s" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
