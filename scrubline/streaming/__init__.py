"""Structured Streaming forms of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators  # noqa: F401
from ..core import ACTIONS, as_list, col, string_columns
from ..operators import text as text_ops
from ..plans.pipeline import apply_transformation


def stream_clean(stream: DataFrame, steps: list[dict]) -> DataFrame:
    """Row-wise steps on a stream; a step that needs the whole table is refused."""
    out = stream
    for step in steps:
        name = step["action"]
        if name not in ACTIONS:
            raise ValueError(f"Unknown cleaning action: '{name}'")
        if not ACTIONS[name].row_wise:
            raise ValueError(f"'{name}' needs the whole table; run it on a batch")
        out = apply_transformation(out, name, step.get("params"))
    return out


def _event_time(stream: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return stream.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, watermark)


def fill_statistics(history: DataFrame, columns=None) -> DataFrame:
    """``(column, value)``: most frequent value per column of a batch table, for joining to a stream."""
    from ..operators.profile import top_values

    return top_values(history, as_list(columns) or string_columns(history), 1).select("column", "value")


def stream_auto_clean(stream: DataFrame, key, ts: str, watermark: str = "1 hour", statistics: DataFrame | None = None) -> DataFrame:
    """Row-wise cleaning, mode fill from a static statistics table, then de-duplication within the watermark."""
    cleaned = (
        stream.transform(text_ops.convert_dirty_nulls).transform(text_ops.trim_whitespace)
        .transform(text_ops.standardise_capitalisation)
    )
    if statistics is not None:
        wide = statistics.groupBy(F.lit(1).alias("_one")).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_modes"))
        # one row with one entry per column of the schema
        names = string_columns(cleaned)
        joined = cleaned.withColumn("_one", F.lit(1)).join(F.broadcast(wide), "_one", "left")
        filled = {c: F.coalesce(col(c), F.try_element_at("_modes", F.lit(c))) for c in names}
        cleaned = joined.withColumns(filled).drop("_one", "_modes")
    return _event_time(cleaned, ts, watermark).dropDuplicatesWithinWatermark(as_list(key))


def quality_counts(df: DataFrame, columns) -> list:
    counts = [F.count("*").alias("rows")]
    for c in as_list(columns):
        counts.append(F.count_if(col(c).isNull()).alias(f"{c}_missing"))
    return counts


def stream_quality(stream: DataFrame, ts: str, columns, window: str = "1 day", slide: str | None = None, watermark: str = "1 hour",
                   group_by=None) -> DataFrame:
    """Rows and missing values per tumbling or sliding window; rows later than the watermark are dropped."""
    timed = _event_time(stream, ts, watermark) if stream.isStreaming else stream.withColumn(ts, col(ts).cast("timestamp"))
    frame = F.window(col(ts), window, slide) if slide else F.window(col(ts), window)
    out = timed.groupBy(frame.alias("w"), *[col(g) for g in as_list(group_by)]).agg(*quality_counts(stream, columns))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def stream_sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Events per key and session (a session ends after ``gap`` without events)."""
    timed = _event_time(stream, ts, watermark) if stream.isStreaming else stream.withColumn(ts, col(ts).cast("timestamp"))
    out = timed.groupBy(col(key), F.session_window(col(ts), gap).alias("s")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")
