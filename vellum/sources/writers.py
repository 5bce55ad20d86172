"""Writers of results: JSON a document, JSONL, a confusion matrix, artifacts, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_documents(rows: DataFrame, folder: str, key: str = "document_id") -> None:
    """One JSON line per document, in folders by document."""
    rows.write.mode("overwrite").partitionBy(key).json(folder)


def jsonl(rows: DataFrame, folder: str, compressed: bool = True) -> None:
    rows.write.mode("overwrite").json(folder, compression="gzip" if compressed else "none")


def confusion_csv(counts: DataFrame, folder: str, classes: list[str]) -> None:
    """A dense matrix of (truth, said, n) with a column per class and 0 where nothing is."""
    wide = counts.groupBy("truth").pivot("said", classes).agg(F.sum("n"))
    every = counts.sparkSession.createDataFrame([(c,) for c in classes], "truth string")
    every.join(wide, "truth", "left").fillna(0).orderBy("truth").coalesce(1).write.mode("overwrite").option("header", "true").csv(folder)


def artifacts(rows: DataFrame, folder: str) -> None:
    """Bytes by deterministic name, kept as Parquet partitioned by kind."""
    rows.write.mode("overwrite").partitionBy("kind").parquet(folder)


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(new: DataFrame, folder: str, keys: list[str]) -> None:
    """Merge into a Parquet folder. The result is written beside it; then the old folder
    gets another name, the new one its name, and only then the old one goes, so that
    one of them is whole at any time. A folder left by a failure is put back first."""
    spark = new.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    folder = folder.rstrip("/")
    path, old, temporary = path_of(folder), path_of(f"{folder}.old"), path_of(f"{folder}.{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def rename(one, other) -> None:
        if not fs.rename(one, other):
            raise OSError(f"{one} can't be renamed")

    if fs.exists(old):  # a merge that failed between its renames, or before it tidied up
        fs.delete(old, True) if fs.exists(path) else rename(old, path)
    rows = merged(spark.read.parquet(folder), new, keys) if fs.exists(path) else new
    rows.write.parquet(temporary.toString())
    if fs.exists(path):
        rename(path, old)
    rename(temporary, path)
    fs.delete(old, True)


def annotations(rows: DataFrame) -> DataFrame:
    """Checked annotations: counts from 0 up, and quadrants that add up to the total."""
    parts = ["top_left", "top_right", "bottom_left", "bottom_right"]
    out = rows.withColumns({c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))) for c in [*parts, "total"]})
    total = F.col(parts[0]) + F.col(parts[1]) + F.col(parts[2]) + F.col(parts[3])
    return out.withColumn("total", F.when(total == F.col("total"), F.col("total")).otherwise(F.raise_error(F.lit("the quadrants don't add up")).cast(rows.schema["total"].dataType)))
