"""Streams: stateless rules on the stream itself, fitted statistics per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names, text
from ..operators import rules


def validated(stream: DataFrame) -> DataFrame:
    """Hidden nulls and column rules, without state."""
    strings = names.of_kind(stream, names.is_text)
    out = stream.withColumns({c: text.null_hidden(F.col(c)) for c in strings}) if strings else stream
    made = {f.name: rules.chunk_rule(f.name, f.dataType) for f in out.schema.fields}
    return out.withColumns(made)


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermarks need a time with a zone: times without one count as the session's."""
    kind = dict(stream.dtypes)[time]
    return (stream.withColumn(time, F.col(time).cast("timestamp")) if kind != "timestamp" else stream).withWatermark(time, delay)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten `delay` behind the latest time."""
    return _timed(stream, time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, delay: str, size: str, group: str, value: str) -> DataFrame:
    """Counts and sums per tumbling window and group."""
    return (
        _timed(stream, time, delay)
        .groupBy(F.window(time, size).alias("w"), group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), group, "n", "total")
    )


def sessions(stream: DataFrame, time: str, delay: str, user: str, gap: str) -> DataFrame:
    return (
        _timed(stream, time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), user)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")
    )


def per_batch(stream: DataFrame, body: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """body(batch) written to path for each micro-batch, each to its own folder: a retried batch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        body(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
