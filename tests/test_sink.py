"""Documents of change sets written by the executors."""

import glob
import os

import pytest
from helpers import items_frame
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tidemark.operators import render
from tidemark.sources import sink


def contents(folder):
    return {os.path.basename(p): open(p, encoding="utf-8").read() for p in glob.glob(f"{folder}/part-*/*")}


def many(spark, sets=300):
    rows = [{"changeset_id": f"set/{k % sets}", "id": f"i{k}", "title": f"t{k} <x>", "severity": ("Low", "High")[k % 2], "category": ("Behavior", "Mechanical")[k % 7 == 0]} for k in range(4 * sets)]
    return items_frame(spark, rows)


def test_suites_and_annotations_come_line_by_line(spark, tmp_path):
    items = many(spark)
    sink.write_documents(render.junit_lines(items, "High"), str(tmp_path / "junit"), extension="xml")
    sink.write_documents(render.annotation_lines(items), str(tmp_path / "github"))
    whole = {sink.file_name(r["changeset_id"], "xml"): r["junit"] for r in render.junit(items, "High").collect()}
    assert contents(tmp_path / "junit") == whole and len(whole) == 300
    listed: dict = {}
    for r in render.github_annotations(items).orderBy("changeset_id", "pos").collect():
        listed.setdefault(sink.file_name(r["changeset_id"], "txt"), []).append(r["annotation"] + "\n")
    assert contents(tmp_path / "github") == {k: "".join(v) for k, v in listed.items()}
    assert not glob.glob(f"{tmp_path}/*/_staged*")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    lines = spark.range(40).select(F.concat(F.lit("c"), "id").alias("changeset_id"), F.lit(1).alias("section"), F.lit("").alias("pos"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("text")).alias("content"))
    with pytest.raises(PySparkException):
        sink.write_documents(lines, str(tmp_path / "out"))
    assert contents(tmp_path / "out") == {} and not glob.glob(f"{tmp_path}/out/_staged*")


def test_names_and_modes(spark, tmp_path):
    ids = ["a/b", "a%2Fb", "..", "", None, "x" * 400, "x" * 400 + "y", "é"]
    assert len({sink.file_name(i, "txt") for i in ids if i is not None}) == 7 and all(len(sink.file_name(i, "txt").encode()) < 255 and "/" not in sink.file_name(i, "txt") for i in ids)
    frame = lambda word: spark.createDataFrame([(i, 1, "", word) for i in ids[:3]], "changeset_id string, section int, pos string, content string")
    sink.write_documents(frame("old"), str(tmp_path))
    sink.write_documents(frame("new"), str(tmp_path), mode="overwrite")
    assert set(contents(tmp_path).values()) == {"new"} and len(contents(tmp_path)) == 3
    sink.write_documents(frame("x").where("false"), str(tmp_path))
    assert len(contents(tmp_path)) == 3
