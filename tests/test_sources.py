"""Readers, writers and streams on small files."""

import gzip
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.sources import readers, writers
from vellum.streaming import stages


def png(path, width=3, height=2):
    raw = b"".join(b"\0" + bytes(range(width)) for _ in range(height))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "page.1.png")
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("x")
    assert {r.document_id for r in readers.document_files(spark, str(tmp_path)).collect()} == {"page.1", "bad"}
    got = {r.document_id: r for r in readers.document_images(spark, str(tmp_path / "*.png")).collect()}
    assert (got["page.1"].height, got["page.1"].width) == (2, 3) and got["bad"].data is None
    for k in (10, 9, 1):
        (tmp_path / "c").mkdir(exist_ok=True)
        png(tmp_path / "c" / f"g{k}.png")
    rows = readers.class_folders(spark, str(tmp_path / "c"), 2).orderBy("place").collect()
    assert [(r.label, r.path.rsplit("/", 1)[1]) for r in rows] == [("c", "g1.png"), ("c", "g9.png")]


def test_json_envelopes(spark, tmp_path):
    for name, body in {"a": [{"label": "x"}, {"char": "y"}], "b": {"records": [{"metadata": {"label": "z"}}]}, "c": {"glyphs": {"k": {"label": "w"}}}, "d": {"label": "v"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "e.json").write_text("{broken")
    got = sorted(r.l for r in readers.json_records(spark, str(tmp_path)).select(readers.label_of(F.col("record")).alias("l")).collect())
    assert got == ["v", "w", "x", "y", "z"]


def test_training_rows(spark, tmp_path):
    row = {"class_id": 1, "source_id": None, "image_path": "p", "sample_kind": "k", "feature_names": ["a", "b"], "vector": [1.0, 2.0]}
    path = tmp_path / "rows.jsonl.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join(json.dumps(row | {"class_id": k}) for k in range(6)))
    rows = readers.training_rows(spark, str(path)).collect()
    assert len(rows) == 6 and rows[0].source_id == "p" and rows[0].vector == [1.0, 2.0]
    for bad in ({"vector": [1.0]}, {"feature_names": ["b", "a"]}):
        with gzip.open(path, "wt") as f:
            f.write("\n".join(json.dumps(r) for r in (row, row | bad)))
        with pytest.raises(Exception, match="length|differ"):
            readers.training_rows(spark, str(path)).collect()


def test_frequencies_and_stage_files(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("rank\tword\tcount\n1\tմի\t9\nbad\n2\tա\t0\n3\tբ\tx\n4\tգ\t2\n")
    assert [(r["rank"], r.word, r["count"]) for r in readers.word_frequencies(spark, str(tmp_path / "f.tsv")).orderBy("rank").collect()] == [(1, "մի", 9), (2, "ա", 0), (4, "գ", 2)]
    assert readers.word_frequencies(spark, str(tmp_path / "f.tsv"), 1).count() == 1
    (tmp_path / "s.json").write_text('{"document_id": "d", "routes": []}')
    assert readers.stage_file(spark, str(tmp_path / "s.json"), ["routes"]).count() == 1
    with pytest.raises(ValueError, match="lacks units"):
        readers.stage_file(spark, str(tmp_path / "s.json"), ["units"])


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, n int")
    writers.json_documents(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.jsonl(rows, str(tmp_path / "l"))
    assert list((tmp_path / "l").glob("*.json.gz"))
    folder = str(tmp_path / "u")
    writers.upsert(rows, folder, ["document_id"])
    writers.upsert(spark.createDataFrame([("d2", 5), ("d3", 6)], "document_id string, n int"), folder, ["document_id"])
    assert sorted(map(tuple, spark.read.parquet(folder).collect())) == [("d1", 1), ("d2", 5), ("d3", 6)]
    writers.confusion_csv(spark.createDataFrame([("a", "b", 2)], "truth string, said string, n int"), str(tmp_path / "c"), ["a", "b"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == [("a", "0", "2"), ("b", "0", "0")]
    marks = spark.createDataFrame([(1, 1, 1, -4, 3)], "top_left int, top_right int, bottom_left int, bottom_right int, total int")
    assert writers.annotations(marks).first().bottom_right == 0
    with pytest.raises(Exception, match="add up"):
        writers.annotations(marks.withColumn("total", F.lit(9))).collect()


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id") * 60)).alias("ts"), F.concat(F.lit("c"), F.col("id") % 3).alias("class"), F.lit("f").alias("feature"), (F.col("id") % 5).cast("string").alias("value"), (F.col("id") % 7).alias("document"), F.concat(F.lit("p"), F.col("id") % 4).alias("phase"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = stages.stage_stream(spark, str(tmp_path / "in"), rows.schema, 1)
    stages.to_updates(stages.feature_counts(stream), f"{tmp_path}/counts", f"{tmp_path}/counts-checkpoint").awaitTermination()
    want = rows.groupBy("class", "feature", "value").count()
    assert sorted(map(tuple, stages.latest(spark.read.parquet(f"{tmp_path}/counts"), "class", "feature", "value").collect())) == sorted(map(tuple, want.collect()))
    stages.to_updates(stages.phase_states(stream, 4), f"{tmp_path}/phases", f"{tmp_path}/phases-checkpoint").awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/phases").groupBy("document").agg(F.max("seen").alias("seen"), F.bool_or("complete").alias("complete")).collect()
    assert {(r.document, r.seen, r.complete) for r in last} == {(k, 4, True) for k in range(7)}
    stages.to_folder(stream.select("class", "value"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_upsert_survives_failures(spark, tmp_path):
    """A folder left between two renames is put back; an old one left behind goes."""
    import os
    import shutil

    folder = f"{tmp_path}/table"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k int, v string")
    read = lambda: sorted(map(tuple, spark.read.parquet(folder).collect()))
    writers.upsert(rows((1, "a"), (2, "b")), folder, ["k"])
    os.rename(folder, f"{folder}.old")  # failed before the new one got its name
    writers.upsert(rows((2, "c")), folder, ["k"])
    assert read() == [(1, "a"), (2, "c")] and not os.path.exists(f"{folder}.old")
    shutil.copytree(folder, f"{folder}.old")  # failed before the old one went
    writers.upsert(rows((3, "d")), folder, ["k"])
    assert read() == [(1, "a"), (2, "c"), (3, "d")] and not os.path.exists(f"{folder}.old")
