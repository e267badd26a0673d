"""Split reading of quoted line breaks, against the reader that takes files whole."""

import random

import pytest

from scrubline.sources import delimited, readers


def write(path, seed, rows, ending="\n", encoding="utf-8"):
    """A file of quoted, doubled, broken, empty and unquoted values."""
    rng = random.Random(seed)
    forms = ["plain", '"a ""quoted"" word"', '"line one{e}line two, with a comma"', '"{e}{e}"', '""', "", '5" pipe', "é ü", '"ends with a quote"""', '"one ""{e}"" two"',
             '"' + "many lines{e}" * 30 + '"']
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(f"id,note,more{ending}")
        for i in range(rows):
            f.write(",".join([str(i), *(rng.choice(forms).format(e=ending) for _ in range(2))]) + ending)
    return str(path)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splits_give_the_same_records(spark, tmp_path, small_splits, seed):
    paths = [write(tmp_path / "a.csv", seed, 400), write(tmp_path / "b.csv", seed + 10, 60)]
    whole = readers.read_delimited(spark, paths, ",", multi_line=True)
    split = readers.read_delimited(spark, paths, ",")
    assert split.columns == whole.columns == ["id", "note", "more"]
    assert sorted(map(repr, split.collect())) == sorted(map(repr, whole.collect()))
    assert split.rdd.getNumPartitions() > 10
    starts, _ = delimited.split_states(delimited._lines(spark, paths, None, ","))
    assert any(starts.values()) and not all(starts.values())


def test_other_line_ends_and_encodings(spark, tmp_path, small_splits):
    path = write(tmp_path / "a.csv", 5, 200, "\r\n", "iso-8859-1")
    rows = {int(r["id"]): r for r in readers.read_delimited(spark, path, ",", "iso-8859-1").collect()}
    assert sorted(rows) == list(range(200)) and "é ü" in {r["note"] for r in rows.values()}
    assert "line one\r\nline two, with a comma" in {(r["note"] or "").replace("\r\n", "\n").replace("\n", "\r\n") for r in rows.values()}


def test_files_without_line_breaks_stay_plain(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,note\n1,"x, y"\n2,5" pipe\n3,"say ""hi"""\n')
    df = readers.read_delimited(spark, str(path))
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["id"], r["note"]) for r in df.orderBy("id").collect()] == [("1", "x, y"), ("2", '5" pipe'), ("3", 'say "hi"')]


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    long = "x\n" * 20_000
    path = tmp_path / "a.csv"
    path.write_text(f'id,note\n1,"{long}"\n2,"{long}y"\n3,z\n')
    rows = {r["id"]: r["note"] for r in readers.read_delimited(spark, str(path), ",").collect()}
    assert rows == {"1": long, "2": long + "y", "3": "z"}


def test_schema_and_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", 7, 50)
    df = readers.read_delimited(spark, str(tmp_path / "in"), ",", schema=readers.T.StructType.fromDDL("id long, note string, more string"))
    assert df.count() == 50 and dict(df.dtypes)["id"] == "bigint" and {r["id"] for r in df.collect()} == set(range(50))
