"""File intake (binaryFile) and the parquet / JSON sinks."""

import os
import tempfile

from talentscope.operators import ingest as I
from talentscope.operators.text_index import TextIndex
from talentscope.sources import codec


def test_upload_files_gate_and_decode(spark):
    folder = tempfile.mkdtemp(prefix="talentscope-uploads-")
    with open(os.path.join(folder, "cv.txt"), "w", encoding="utf-8") as f:
        f.write("Gil\ngil@x.io\nSkills\nsql\nExperience\ndev\n")
    with open(os.path.join(folder, "cv.exe"), "wb") as f:
        f.write(b"\x00\x01")
    out = {r["file_name"]: r for r in I.read_upload_files(spark, folder).collect()}
    assert out["cv.txt"]["accepted"] and out["cv.txt"]["text"].startswith("Gil\n")
    assert not out["cv.exe"]["accepted"] and out["cv.exe"]["text"] is None


def test_ingest_split_sink_and_index_sink(spark):
    docs = spark.createDataFrame(
        [(1, 7, "Hal\nhal@x.io\nSkills\nsql\nExperience\ndev at co\n"), (2, 7, "")],
        "id long, created_by long, content string")
    res = I.ingest(docs)
    base = tempfile.mkdtemp(prefix="talentscope-sinks-")
    I.write_ingest(res, os.path.join(base, "accepted"), os.path.join(base, "quarantine"))
    acc = spark.read.parquet(os.path.join(base, "accepted"))
    quar = spark.read.parquet(os.path.join(base, "quarantine"))
    assert [r["id"] for r in acc.collect()] == [1]
    assert [r["id"] for r in quar.collect()] == [2]
    TextIndex(spark, os.path.join(base, "index"), 4).change(added=docs)
    idx = spark.read.parquet(os.path.join(base, "index", "postings"))
    assert {"token", "doc_id", "tf", "segment", "bucket"} == set(idx.columns)
    assert idx.filter("token = 'sql'").count() == 1


def test_json_export_round_trip(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    path = os.path.join(tempfile.mkdtemp(prefix="talentscope-json-"), "out")
    codec.write_json(df, path)
    back = spark.read.schema("id long, v string").json(path)
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]
    assert codec.encode_json(df).columns == ["json"]


def test_files_through_the_ingest_pipeline(spark):
    """binaryFile intake feeds the pipeline: the path is the upload id and the
    decoded text the content (PDF/DOCX text needs the external extractor)."""
    from pyspark.sql import functions as F

    folder = tempfile.mkdtemp(prefix="talentscope-pipeline-")
    files = {"good.txt": "Gil\ngil@x.io\nSkills\nsql\nExperience\ndev\n",
             "noskills.txt": "Ada\nada@x.io\nExperience\nclerk\n"}
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    with open(os.path.join(folder, "tool.exe"), "wb") as f:
        f.write(b"\x00\x01")
    intake = I.read_upload_files(spark, folder)
    uploads = intake.select(F.col("path").alias("id"), "file_name", "size_bytes")
    docs = intake.select(F.col("path").alias("id"), F.lit(7).cast("long").alias("created_by"),
                         F.col("text").alias("content"))
    out = {r["id"].rsplit("/", 1)[-1]: r for r in I.ingest_pipeline(uploads, docs).collect()}
    assert out["good.txt"]["status"] == "accepted" and out["good.txt"]["name"] == "Gil"
    assert out["noskills.txt"]["status"] == "quarantined"
    assert out["tool.exe"]["status"] == "rejected" and out["tool.exe"]["content"] is None
