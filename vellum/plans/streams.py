"""The streaming form of aggregates: a replay of events must equal the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.sources.durable import scratch_dir
from vellum.streaming import stages

from .registry import query


def replay(t):
    """The events table as a stream of files."""
    schema = t.events.schema
    folder, name = t._dir, "events.parquet"
    return t.spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def replayed(t, stream, *keys: str):
    """The state that a stream ends with, by way of files that all executors share."""
    folder = f"{scratch_dir(t.spark)}/vellum-stream-{uuid.uuid4().hex}"
    stages.to_updates(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return stages.latest(t.spark.read.parquet(f"{folder}/rows"), *keys)


@query("x1_streamed_feature_counts", "SELECT event_type AS class, 'k' AS feature, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY ALL")
def streamed_feature_counts(t):
    rows = replay(t).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("class"), F.lit("k").alias("feature"), F.get_json_object("props", "$.k").alias("value"))
    return replayed(t, stages.feature_counts(rows), "class", "feature", "value")


@query("x2_streamed_windowed_routes", """WITH c AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, value / 100 AS printed, (event_id % 10) / 10 AS handwriting, (user_id % 10) / 10 AS noise FROM events) SELECT start, CASE WHEN noise >= 0.65 AND NOT printed >= 0.45 AND NOT handwriting >= 0.45 THEN 'empty_or_noise' WHEN printed >= 0.45 AND handwriting >= 0.45 THEN 'mixed' WHEN printed >= 0.45 AND handwriting >= 0.25 THEN 'mixed' WHEN printed >= 0.45 THEN 'printed_only' WHEN handwriting >= 0.45 THEN 'handwriting_only' ELSE 'review' END AS visual, count(*) AS n FROM c GROUP BY ALL""")
def streamed_windowed_routes(t):
    rows = replay(t).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 100).alias("printed"), (F.col("event_id") % 10 / 10).alias("handwriting"), (F.col("user_id") % 10 / 10).alias("noise"))
    return replayed(t, stages.windowed_routes(rows, "1 day"), "window", "visual").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "visual", "n")
