"""Readers of staged records: folders of images, JSON envelopes, JSONL, TSV, class folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.columns import natural_key

# Extensions of document images, and envelopes and aliases of records.
IMAGES = "{png,jpg,jpeg,tif,tiff,bmp,PNG,JPG,JPEG,TIF,TIFF,BMP}"
ENVELOPES = ("annotations", "records", "samples", "items", "glyphs")
LABEL_ALIASES = ("label", "class_label", "class_name", "character", "char", "letter", "glyph")

TRAINING = T.StructType([T.StructField("class_id", T.LongType()), T.StructField("source_id", T.StringType()), T.StructField("image_path", T.StringType()), T.StructField("sample_kind", T.StringType()), T.StructField("feature_names", T.ArrayType(T.StringType())), T.StructField("vector", T.ArrayType(T.DoubleType()))])


def document_id(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, path, length and content of the images right in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{IMAGES}").option("recursiveFileLookup", "false").load(folder)
    return files.select(document_id(F.col("path")).alias("document_id"), "path", "length", "content")


def document_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images (height, width, channels, BGR bytes); unreadable files have null data."""
    rows = spark.read.format("image").option("dropInvalid", "false").load(folder)
    bad = F.col("image.height") < 0
    return rows.select(document_id(F.col("image.origin")).alias("document_id"), *[F.when(~bad, F.col(f"image.{c}")).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])


def class_folders(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """label (the parent folder) and path of files, in natural order, at most ``limit`` a label."""
    from pyspark.sql import Window

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{IMAGES}").load(folder).select("path", "length")
    rows = rows.withColumn("label", F.element_at(F.split("path", "/"), -2)).withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(natural_key(F.col("path")), "path")))
    return rows.filter(F.col("place") <= limit) if limit else rows


def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """path, nth and record (VARIANT) of every JSON file below a folder.

    A file may hold a list, an object whose known key holds a list or an object of
    records, or a single record. What isn't JSON gives no record."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    inside = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "variant") for k in ENVELOPES], F.col("v"))
    one = files.filter("v is not null").withColumn("w", inside).withColumn("kind", F.schema_of_variant("w"))
    listed = F.try_variant_get("w", "$", "array<variant>")
    keyed = F.when(F.try_variant_get("v", "$", "map<string,variant>").isNotNull() & F.coalesce(*[F.try_variant_get("v", f"$.{k}", "variant") for k in ENVELOPES]).isNotNull(), F.map_values(F.try_variant_get("w", "$", "map<string,variant>")))
    return one.select("path", F.posexplode(F.coalesce(listed, keyed, F.array("w"))).alias("nth", "record"))


def label_of(record: Column) -> Column:
    """The first alias that a record or its metadata has."""
    get = lambda p: F.nullif(F.try_variant_get(record, p, "string"), F.lit(""))
    return F.coalesce(*[get(f"$.{a}") for a in LABEL_ALIASES], *[get(f"$.metadata.{a}") for a in LABEL_ALIASES])


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSONL or JSONL.gz, checked: equal feature names, vectors of their length,
    finite numbers; a missing source id falls back to the image path."""
    raw = spark.read.schema(TRAINING).json(path).withColumn("source_id", F.coalesce(F.nullif("source_id", F.lit("")), "image_path"))
    names = raw.agg(F.min(F.to_json("feature_names")).alias("a"), F.max(F.to_json("feature_names")).alias("b"))
    same = names.select((F.col("a") == F.col("b")).alias("same")).scalar()
    checked = F.when(~same, F.raise_error(F.lit("feature names differ"))).when(F.size("vector") != F.size("feature_names"), F.raise_error(F.lit("a vector of another length"))).when(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.raise_error(F.lit("a number that is not finite"))).otherwise(F.col("vector"))
    return raw.withColumn("vector", checked)


def word_frequencies(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """rank, word and count of a TSV with or without header; malformed rows are left out."""
    raw = spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").schema("rank string, word string, count string").csv(path)
    rows = raw.select(F.col("rank").try_cast("bigint").alias("rank"), F.btrim("word").alias("word"), F.col("count").try_cast("bigint").alias("count")).filter("rank is not null and count is not null and word <> ''")
    return rows.orderBy("rank").limit(most) if most else rows


def stage_file(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A stage's JSON; a missing required column is an error."""
    rows = spark.read.option("multiLine", "true").json(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
