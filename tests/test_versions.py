"""Hash trees of versions, what a diff reads, and writers at the same time."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from scrubline.operators.compare import diff_by_key
from scrubline.sources import versions


def _files(df):
    """Files that the scans of a plan read after pruning."""
    found, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found += [f.filePath().toString() for f in node.selectedPartitions().toPartitionArray()]
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(3000).selectExpr("id", "IF(id % 7 = 0, null, 'v' || id) AS v", "id % 13 AS n").repartition(4)


def test_one_changed_row_reads_one_bucket(spark, df, tmp_path):
    root = str(tmp_path)
    one = versions.save_version(df, root, "first", keys="id", buckets=64)
    two = versions.save_version(df.withColumn("n", F.when(F.col("id") == 77, 100).otherwise(F.col("n"))), root, "second", one, "id", 64)
    assert len(versions.changed_buckets(spark, root, one, two)) == 1
    diff = versions.diff_versions(spark, root, one, two)
    assert [(r.id, r.change, r.column, r.before, r.after) for r in diff.collect()] == [(77, "changed", "n", "12", "100")]
    assert {os.path.basename(os.path.dirname(f)) for f in _files(diff)} == {f"_bucket={b}" for b in versions.changed_buckets(spark, root, one, two)}
    assert versions.read_version(spark, root, one).columns == ["id", "v", "n"]


def test_a_diff_equals_that_of_whole_versions(spark, df, tmp_path):
    root = str(tmp_path)
    other = df.where("id % 100 <> 5").withColumn("v", F.when(F.col("id") % 211 == 0, None).when(F.col("id") == 7, "new").otherwise(F.col("v"))).unionByName(
        spark.range(5000, 5003).selectExpr("id", "'x' AS v", "0L AS n"))
    one = versions.save_version(df, root, "a", keys=["id"], buckets=40)
    two = versions.save_version(other, root, "b", one, ["id"], 40)
    got = versions.diff_versions(spark, root, one, two)
    assert sorted(map(str, got.collect())) == sorted(map(str, diff_by_key(df, other, "id").collect()))
    back = versions.rollback(spark, root, one)
    assert versions.changed_buckets(spark, root, one, back) == [] and versions.diff_versions(spark, root, one, back).count() == 0


def test_nulls_and_equal_sums_are_told_apart(spark, tmp_path):
    root = str(tmp_path)
    a = spark.createDataFrame([(1, "x", None), (2, None, "x")], "k int, a string, b string")
    b = spark.createDataFrame([(1, None, "x"), (2, "x", None)], "k int, a string, b string")
    one, two = (versions.save_version(d, root, "n", keys="k", buckets=1) for d in (a, b))
    assert versions.diff_versions(spark, root, one, two).count() == 4
    empty = versions.save_version(a.limit(0), root, "none", keys="k", buckets=1)
    assert {r.change for r in versions.diff_versions(spark, root, one, empty).collect()} == {"removed"}


def test_writers_at_once_get_numbers_of_their_own(spark, df, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: versions.save_version(spark.range(i + 1), root, f"w{i}"), range(4)))
    assert sorted(numbers) == [1, 2, 3, 4]
    assert {r.version: r["rows"] for r in versions.list_versions(spark, root).collect()} == {n: i + 1 for i, n in enumerate(numbers)}


def test_a_number_claimed_in_between_is_passed_over(spark, tmp_path, monkeypatch):
    path_of, seen = versions._path, []

    class Late:
        """A file system that first doesn't see another writer's claim."""

        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def exists(self, path):
            seen.append(path.toString())
            return (not path.toString().endswith("claims/1") or seen.count(path.toString()) > 1) and self.files.exists(path)

        def createNewFile(self, path):
            self.files.create(path, False).close()
            return True

    root = str(tmp_path)
    first = versions._claim(spark, root)
    monkeypatch.setattr(versions, "_path", lambda *a: (Late(path_of(*a)[0]), path_of(*a)[1]))
    assert (first, versions._claim(spark, root)) == (1, 2)


def test_versions_without_a_tree_are_not_compared(spark, tmp_path):
    root = str(tmp_path)
    one, two = versions.save_version(spark.range(2), root, "a"), versions.save_version(spark.range(2), root, "b", keys="id", buckets=4)
    with pytest.raises(ValueError):
        versions.changed_buckets(spark, root, one, two)
    with pytest.raises(ValueError):
        versions.read_version(spark, root, 9)
