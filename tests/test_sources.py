"""Sources and sinks: round trips over small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from orrery.sources import graphs, json as surveys, logs


def test_survey_round_trip(spark, tmp_path):
    doc = {"schema_version": "1", "view": "behavior_map", "nodes": [{"id": "a", "name": "x"}, {"id": "b", "extra": 1}], "edges": [{"id": "e", "src": "a", "dst": "b", "confidence": 0.5}]}
    with gzip.open(tmp_path / "survey.json.gz", "wt") as f:
        json.dump(doc, f)
    (tmp_path / "behavior_map.json").write_text(json.dumps(doc | {"view": "compact"}))
    found = surveys.find_survey(spark, str(tmp_path))
    assert found.endswith("survey.json.gz")
    read = surveys.read_survey(spark, found)
    assert [r.id for r in surveys.survey_nodes(read).collect()] == ["a", "b"] and surveys.survey_edges(read).first().dst == "b"
    with pytest.raises(Exception, match="not a survey"):
        surveys.survey_nodes(surveys.read_survey(spark, str(tmp_path / "behavior_map.json"))).collect()
    surveys.write_survey(surveys.survey_nodes(read), surveys.survey_edges(read), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).count() == 2
    assert surveys.find_survey(spark, str(tmp_path / "out")) is None


def test_logs(spark, tmp_path):
    (tmp_path / "d.log").write_text("== slowest ==\n1.50s setup    tests/a.py::t[x 1]\n 0.25s call     tests/a.py::t[x 1]\n9s call x\n")
    assert logs.read_durations(spark, str(tmp_path / "d.log")).collect() == [("tests/a.py::t[x 1]", 1.5, 0.25, None)]
    logs.append_json_lines(spark.createDataFrame([(1, "x")], "sha int, at string"), str(tmp_path / "log"))
    logs.append_json_lines(spark.createDataFrame([(2, "y")], "sha int, at string"), str(tmp_path / "log"))
    (tmp_path / "log/bad.json").write_text("{not json\n")
    assert sorted(r.sha for r in logs.read_json_lines(spark, str(tmp_path / "log"), "sha int, at string").collect()) == [1, 2]
    (tmp_path / "j.xml").write_text('<testsuite><testcase classname="a.B" name="t1"><failure>no</failure></testcase><testcase classname="a.B" name="t2"/></testsuite>')
    assert {(r.test, r.failed) for r in logs.read_junit(spark, str(tmp_path / "j.xml")).collect()} == {("a.B::t1", True), ("a.B::t2", False)}


def test_stored_graphs(spark, tmp_path):
    rows = spark.createDataFrame([("b1", 1), ("b2", 2), ("b2", 3)], "build string, node int")
    graphs.store(rows, str(tmp_path / "g"), "build")
    graphs.store(rows.where("node = 3"), str(tmp_path / "g"), "build")
    assert [r.node for r in graphs.newest(spark, str(tmp_path / "g"), "build").collect()] == [3]
    assert [r.node for r in graphs.newest(spark, str(tmp_path / "g"), "build", before="b2").collect()] == [1]
    up = graphs.upsert(rows, spark.createDataFrame([("b2", 9)], "build string, node int"), "build")
    assert sorted(r.node for r in up.collect()) == [1, 9]
    graphs.write_csv(rows.withColumn("mean", F.lit(None).cast("string")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["build", "node", "mean"]
    (tmp_path / "f.txt").write_bytes(b"abc")
    digests = {r.path.rsplit("/", 1)[1]: r.digest for r in graphs.file_digests(spark, str(tmp_path)).collect()}
    assert digests["f.txt"].startswith("ba7816bf")
