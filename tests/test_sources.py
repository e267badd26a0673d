"""Readers, writers, versions and streams on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scrubline import streaming
from scrubline.sources import readers, versions, writers


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_delimited(spark, tmp_path):
    for mark, name in ((",", "a.csv"), (";", "b.csv"), ("\t", "c.tsv"), ("|", "d.txt")):
        path = put(tmp_path, name, mark.join(["id", "name"]) + "\n" + mark.join(["1", "x, y"[: 1 if mark == "," else 4]]) + "\n")
        df = readers.read_delimited(spark, path)
        assert df.columns == ["id", "name"] and df.count() == 1


def test_json_forms(spark, tmp_path):
    rows = [{"id": 1, "at": {"city": "x", "geo": {"lat": 1.5}}}, {"id": 2, "at": {"city": "y", "geo": {"lat": 2.5}}}]
    for name, body in (("a.json", rows), ("b.json", {"records": rows, "total": 2})):
        df = readers.read_json_records(spark, put(tmp_path, name, json.dumps(body)))
        assert set(df.columns) == {"id", "at_city", "at_geo_lat"} and df.count() == 2
    path = put(tmp_path, "c.jsonl", '{"id": 1}\n\n# note\n{"id": 2}\nbroken\n')
    df = readers.read_jsonl(spark, path, "id long")
    assert df.count() == 3 and df.where("_corrupt_record is not null").count() == 1


def test_folder_and_collection(spark, tmp_path):
    put(tmp_path, "in/one.csv", "a,b\n1,2\n")
    put(tmp_path, "in/deep/two.csv", "a,b\n3,4\n5,6\n")
    tables = readers.read_folder(spark, f"{tmp_path}/in")
    assert {n: t.count() for n, t in tables.items()} == {"one": 1, "two": 2}
    long = readers.read_collection(spark, f"{tmp_path}/in")
    assert {r.dataset: r["count"] for r in long.groupBy("dataset").count().collect()} == {"one": 1, "two": 2}


def test_writers_and_checksum(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "timestamp'2024-01-01 00:00:00' AS t", "id % 2 AS dataset")
    for fmt in ("csv", "json", "parquet"):
        writers.write(df.drop("dataset"), f"{tmp_path}/{fmt}", fmt)
    assert dict(spark.read.parquet(f"{tmp_path}/parquet").dtypes)["t"] == "timestamp_ntz"
    writers.write_collection(df, f"{tmp_path}/parts")
    assert spark.read.parquet(f"{tmp_path}/parts").count() == 5
    assert writers.checksum(df) == writers.checksum(df.repartition(3).orderBy(F.desc("id")))


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/v"
    assert versions.list_versions(spark, root).count() == 0
    one = versions.save_version(spark.range(3), root, "first")
    two = versions.save_version(spark.range(5), root, "second", one)
    back = versions.rollback(spark, root, one)
    listed = versions.list_versions(spark, root).collect()
    assert [(r.version, r.parent, r["rows"], r.status) for r in listed] == [(3, 1, 3, "active"), (2, 1, 5, "archived"), (1, None, 3, "archived")]
    assert versions.read_version(spark, root, back).count() == 3 and versions.read_version(spark, root, two).count() == 5
    assert listed[0].checksum == listed[2].checksum
    with pytest.raises(ValueError):
        versions.rollback(spark, root, 99)


def test_jdbc_guard(spark):
    # the read itself needs a database, which tests do not start
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "jdbc:none:x", query="DELETE FROM t")
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "jdbc:none:x", query="SELECT 1; DROP TABLE t")
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "jdbc:none:x")


def test_stream_equals_batch_and_refuses_global_steps(spark, tmp_path):
    put(tmp_path, "s/a.csv", "id,name\n1,  ann \n2,bob\n")
    put(tmp_path, "s/b.csv", "id,name\n3, cat\n")
    stream = readers.read_stream(spark, f"{tmp_path}/s", "id int, name string", max_files=1)
    steps = [{"action": "trim_whitespace"}, {"action": "standardise_capitalisation"}]
    query = writers.write_stream(streaming.stream_clean(stream, steps), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "Ann"), (2, "Bob"), (3, "Cat")}
    for name in ("remove_duplicates", "scale_numeric", "fill_missing"):
        with pytest.raises(ValueError):
            streaming.stream_clean(stream, [{"action": name}])


def test_stream_fill_from_statistics(spark, tmp_path):
    put(tmp_path, "e/a.csv", "id,ts,kind\n1,2024-01-01 00:00:00,n/a\n1,2024-01-01 00:00:00,view\n2,2024-01-01 00:01:00,click\n")
    history = spark.createDataFrame([("View",), ("View",), ("Click",)], "kind string")
    stream = readers.read_stream(spark, f"{tmp_path}/e", "id int, ts timestamp, kind string")
    out = streaming.stream_auto_clean(stream, "id", "ts", "1 hour", streaming.fill_statistics(history))
    writers.write_stream(out, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/o").select("id", "kind").collect()} == {(1, "View"), (2, "Click")}
