"""Queries for scans, message decoding and streams over the test tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from .. import streaming
from ..sources import readers, writers
from .base import query


@query("read_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def read_parquet(t):
    return readers.read_parquet(t.spark, t.path("lineitem"), ["l_orderkey", "l_quantity", "l_shipdate"]).where(
        "l_shipdate >= timestamp_ntz'1998-01-01 00:00:00'").drop("l_shipdate")


@query("decode_messages_json", """
SELECT event_id AS _kafka_offset, CAST(user_id % 4 AS BIGINT) AS _kafka_partition, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 5 = 0 THEN 'oops ' || event_id END AS raw FROM events""")
def decode_messages_json(t):
    messages = t.events.selectExpr("CASE WHEN event_id % 5 = 0 THEN 'oops ' || event_id ELSE props END AS value", "user_id % 4 AS partition", "event_id AS offset", "ts AS timestamp")
    return readers.decode_messages(messages, "json", "k long").drop("_kafka_timestamp")


@query("decode_messages_csv", """
SELECT event_id AS _kafka_offset, CAST(user_id AS VARCHAR) AS field_0, event_type AS field_1, NULL AS raw FROM events""")
def decode_messages_csv(t):
    messages = t.events.selectExpr("user_id || ',' || event_type AS value", "0 AS partition", "event_id AS offset", "ts AS timestamp")
    return readers.decode_messages(messages, "csv", fields=2).drop("_kafka_timestamp", "_kafka_partition")


def scratch() -> str:
    """Folder of one local run; on a cluster the sinks take shared paths from the caller."""
    return tempfile.mkdtemp(prefix="scrubline-run-")


def drain(t, stream, mode: str = "append"):
    """Run a file stream to its end and return what the sink holds."""
    folder = shared_folder(t.spark)
    if mode == "append":
        done = writers.write_stream(stream, f"{folder}/out", f"{folder}/checkpoint")
        done.awaitTermination()
        return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/batch")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/batch")


def shared_folder(spark) -> str:
    """New folder below the cluster's checkpoint folder; a local session may use its own."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/scrubline-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return scratch()


def event_stream(t):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


@query("stream_clean", "SELECT event_id, upper(event_type) AS event_type, value > 100 AS big FROM events WHERE event_type <> 'view'")
def stream_clean(t):
    steps = [
        {"action": "drop_rows_where", "params": {"column": "event_type", "value": "view"}},
        {"action": "standardise_capitalisation", "params": {"columns": ["event_type"], "strategy": "upper"}},
        {"action": "formula_column", "params": {"new_column": "big", "expression": "value > 100"}},
        {"action": "drop_columns", "params": {"columns": ["ts", "user_id", "value", "props"]}},
    ]
    return drain(t, streaming.stream_clean(event_stream(t), steps))


@query("stream_auto_clean", "SELECT event_id, upper(event_type[1]) || lower(event_type[2:]) AS event_type FROM events")
def stream_auto_clean(t):
    # every event arrives twice
    stream = event_stream(t).select("event_id", "ts", "event_type").withColumn("event_type", F.explode(F.array("event_type", F.concat(F.lit(" "), "event_type"))))
    cleaned = streaming.stream_auto_clean(stream, "event_id", "ts", "1 hour")
    return drain(t, cleaned).drop("ts")


QUALITY_SQL = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS rows, count_if(event_id % 3 = 0) AS value_missing FROM events GROUP BY ALL"""


def with_gaps(df):
    return df.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))


@query("quality_by_window", QUALITY_SQL)
def quality_by_window(t):
    out = streaming.stream_quality(with_gaps(t.events), "ts", "value", "1 day", group_by="event_type")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "rows", "value_missing")


@query("stream_quality", QUALITY_SQL)
def stream_quality(t):
    out = streaming.stream_quality(with_gaps(event_stream(t)), "ts", "value", "1 day", group_by="event_type")
    return drain(t, out, "complete").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "rows", "value_missing")


@query("quality_sliding", """
SELECT strftime(d + INTERVAL (k) DAY - INTERVAL 1 DAY, '%Y-%m-%d') AS day, count(*) AS rows FROM (SELECT date_trunc('day', ts) AS d FROM events), range(0, 2) r(k) GROUP BY 1""")
def quality_sliding(t):
    out = streaming.stream_quality(t.events, "ts", [], "2 days", "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rows")


@query("sessions", """
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM n GROUP BY user_id, k""")
def sessions(t):
    out = streaming.stream_sessions(t.events, "user_id", "ts", "2 hours")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


@query("clean_headers_folder", "SELECT 'nation' AS dataset, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def clean_headers_folder(t):
    folder = shared_folder(t.spark)
    writers.write_folder({"nation": t.nation, "region": t.region}, folder, "csv")
    out = t.spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    name = F.regexp_extract(F.input_file_name(), r"/(nation|region)/", 1)
    return out.select(name.alias("dataset")).groupBy("dataset").agg(F.count("*").alias("rows"))
