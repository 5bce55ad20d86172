"""The aggregates over streams of stage records, and the state of documents' phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import routing


def stage_stream(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 8) -> DataFrame:
    """Records of a stage folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def feature_counts(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts of (class, feature, value); records later than the watermark are dropped."""
    return records.withWatermark("ts", late).groupBy("class", "feature", "value").agg(F.count("*").alias("n"))


def windowed_routes(records: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Visual classes per tumbling window of arrival."""
    visual = routing.visual_class(F.col("printed"), F.col("handwriting"), F.col("noise"))
    return records.withWatermark("ts", late).groupBy(F.window("ts", size), visual.alias("visual")).agg(F.count("*").alias("n"))


PHASES = T.StructType([T.StructField("document", T.LongType()), T.StructField("seen", T.IntegerType()), T.StructField("complete", T.BooleanType())])


def phase_states(records: DataFrame, needed: int, late: str = "1 hour") -> DataFrame:
    """How many distinct phases of each document have arrived, and whether all have.

    The state of a document is its set of phases and goes once the
    watermark of ``ts`` is an hour past what it was at the document's last record."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        seen = set((state.get[0] or "").split(",")) - {""} if state.exists else set()
        for pdf in batches:
            seen |= set(pdf["phase"])
        state.update((",".join(sorted(seen)),))
        state.setTimeoutTimestamp(max(0, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame({"document": [key[0]], "seen": [len(seen)], "complete": [len(seen) >= needed]})

    return records.withWatermark("ts", late).select("ts", "document", "phase").groupBy("document").applyInPandasWithState(update, PHASES, "phases string", "update", GroupStateTimeout.EventTimeTimeout)


def to_folder(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over all that is there now."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)


def to_updates(rows: DataFrame, folder: str, checkpoint: str):
    """Runs a stream over all that is there now; each batch's changed rows go to a folder
    of the batch, which a batch that runs again after a failure writes anew."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key from the folder of ``to_updates``."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
