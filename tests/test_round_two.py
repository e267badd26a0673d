"""Answers that must not depend on number size, line breaks, cycles or partitioning."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scrubline import operators  # noqa: F401
from scrubline.core import name_words
from scrubline.functions.stats import quantiles
from scrubline.operators import aggregate, anomalies, compare, lineage, missing, schema, windows
from scrubline.sources import readers, writers


def test_csv_round_trip_with_quotes_and_line_breaks(spark, tmp_path):
    rows = [("a,b", 'say "hi"', "one\ntwo"), ("c", "\\", " x "), ("d", 'end"', "\n")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    writers.write(df, str(tmp_path / "t"), "csv")
    back = readers.read_delimited(spark, str(tmp_path / "t"), ",")
    assert sorted((r.x, r.y, r.z) for r in back.collect()) == sorted(rows)


def test_encoding_is_found(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name;city\nJosé;Köln\n".encode("iso-8859-1"))
    (tmp_path / "b.csv").write_bytes("name;city\nJosé;Köln\n".encode())
    for name in ("a.csv", "b.csv"):
        row = readers.read_delimited(spark, str(tmp_path / name), encoding="auto").first()
        assert (row["name"], row["city"]) == ("José", "Köln")


def test_long_numbers_stay_whole(spark):
    df = spark.createDataFrame([("9007199254740993", 9007199254740993), (" 12.0 ", 5), ("1.5", None), ("99999999999999999999", 1)], "t string, n long")
    out = schema.cast_type(schema.cast_type(df, "t", "int"), "n", "int")
    assert [(r.t, r.n) for r in out.collect()] == [(9007199254740993, 9007199254740993), (12, 5), (None, None), (None, 1)]


def test_ranks_of_long_numbers_and_text(spark):
    base = 2 ** 53
    df = spark.createDataFrame([(base, "a"), (base + 1, "b"), (base + 2, "b"), (base + 1, "c")], "v long, t string")
    assert [r.r for r in windows.add_rank(df, "v", "min", "r").orderBy("v", "t").collect()] == [4, 2, 2, 1]
    assert [r.r for r in windows.add_rank(df, "t", "max", "r").orderBy("t").collect()] == [4, 3, 3, 1]
    assert [r.r for r in windows.add_rank(df, "v", "first", "r", order_by="t").orderBy("v", "t").collect()] == [4, 2, 3, 1]


def test_running_deviation_of_large_values(spark):
    df = spark.createDataFrame([(1, 1e9), (2, 1e9 + 0.001), (3, None), (4, 0.0)], "i int, v double")
    out = windows.cumulative_stats(df, "v", ["std"], order_by="i").orderBy("i").collect()
    assert out[0].v_cum_std is None and abs(out[1].v_cum_std - 0.0007071) < 1e-6 and abs(out[3].v_cum_std / 577350269.4 - 1) < 1e-9


def test_quantiles_of_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (float("inf"),), (float("inf"),)], "v double")
    assert quantiles(df, {"v": F.col("v")}, [0.0, 0.9, 1.0])["v"] == [1.0, float("inf"), float("inf")]


def test_lineage_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "source string, target string")
    assert {(r.node, r.depth) for r in lineage.impact_analysis(edges, "a").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    assert {r.node for r in lineage.column_lineage(edges, "d").collect()} == {"a", "b", "c", "d"}


def test_forest_does_not_depend_on_partitions(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 37 AS double) AS x", "cast(if(id = 7, 900, id % 11) AS double) AS y")
    flagged = [{r.id for r in anomalies.isolation_forest(df.repartition(n), ["x", "y"], trees=10).where("is_anomaly").collect()} for n in (1, 8)]
    assert flagged[0] == flagged[1] and 7 in flagged[0]


def test_forest_sees_few_and_hot_values(spark, monkeypatch):
    forests = []
    scorer = anomalies._scorer
    monkeypatch.setattr(anomalies, "_scorer", lambda trees, sample: forests.append(trees) or scorer(trees, sample))
    # a third of a million rows holds one value, the others hold 49, and one row is far away
    df = spark.range(1_000_000).selectExpr("cast(CASE WHEN id = 5 THEN 100000 WHEN id % 3 = 0 THEN 7 ELSE 100 + id % 49 END AS double) AS x")
    out = anomalies.isolation_forest(df, ["x"], contamination=0.01)
    score = {r.x: r.s for r in out.groupBy("x").agg(F.first("anomaly_score").alias("s")).collect()}
    assert len(forests[0]) == 100 and min(nodes[0][4] for nodes in forests[0]) > 200
    assert len(score) == 51 and all(0 < s < 1 for s in score.values()) and score[100000.0] == max(score.values())
    # rows that reach the leaf of the hot value
    hot = []
    for nodes in forests[0]:
        at = 0
        while nodes[at][0] >= 0:
            at = nodes[at][2] if 7.0 < nodes[at][1] else nodes[at][3]
        hot.append(nodes[at][4] / nodes[0][4])
    assert 0.30 < sum(hot) / 100 < 0.40 and max(hot) < 0.6


def test_forest_scores_by_tables_as_by_nodes(monkeypatch):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"x": rng.integers(0, 9, 900).astype(float), "y": rng.normal(size=900), "z": rng.normal(size=900).round(1)})
    trees = []
    for t in range(9):
        part = rows.sample(100, random_state=t).assign(_tree=t, _h=range(100))
        trees.append([(r.feature, r.cut, r.left, r.right, r.size_) for r in anomalies._grow(["x", "y", "z"], 7)(part).rename(columns={"size": "size_"}).itertuples()])
    trees[4] = [(-1, 0.0, -1, -1, 3)]
    # values on a cut, beyond all cuts and missing
    rows.loc[:2, "y"] = [next(n[1] for n in trees[0] if n[0] == 1), float("inf"), float("-inf")]
    rows.loc[3, "z"] = float("nan")

    def expected(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n

    def score(row):
        depth = 0.0
        for nodes in trees:
            at = steps = 0
            while nodes[at][0] >= 0:
                at, steps = nodes[at][2] if row[nodes[at][0]] < nodes[at][1] else nodes[at][3], steps + 1
            depth += steps + expected(nodes[at][4])
        return 2.0 ** (-(depth / len(trees)) / expected(100))

    wanted = [float("nan") if np.isnan(r).any() else score(r) for r in rows.to_numpy()]
    # all trees as tables, some of them, none, and several blocks
    for cells, block in ((1 << 18, 128), (6000, 128), (0, 128), (1 << 18, 2)):
        monkeypatch.setattr(anomalies, "TREE_CELLS", cells)
        monkeypatch.setattr(anomalies, "TREES_PER_BLOCK", block)
        assert np.allclose(anomalies._scorer(trees, 100)(rows.x, rows.y, rows.z), wanted, rtol=1e-14, atol=0, equal_nan=True)


def test_forest_scores_each_row_twice_at_most(spark, monkeypatch, tmp_path):
    scorer, log = anomalies._scorer, str(tmp_path / "scored")

    def counting(trees, sample):
        score = scorer(trees, sample)

        def counted(*columns: pd.Series) -> pd.Series:
            with open(log, "a") as f:
                f.write(f"{len(columns[0])}\n")
            return score(*columns)

        return counted

    monkeypatch.setattr(anomalies, "_scorer", counting)
    # more rows than the quantile takes at once, and two that have no score
    df = spark.range(60_000).selectExpr("id", "cast(if(id < 2, NULL, xxhash64(id) % 1000) AS double) AS x", "cast(id % 7 AS double) AS y")
    out = anomalies.isolation_forest(df, ["x", "y"], trees=10).collect()
    assert len(out) == 60_000 and sum(r.is_anomaly for r in out) <= 3000 and sum(r.anomaly_score is None for r in out) == 2
    with open(log) as f:
        assert sum(int(line) for line in f) <= 120_000


def test_forest_draws_the_same_by_any_number_of_buckets(spark, monkeypatch):
    df = spark.range(100_000).selectExpr("CASE WHEN id % 5 = 0 THEN 7D WHEN id % 5 = 1 THEN id % 100 * if(id % 2 = 0, 1D, -1D) WHEN id % 5 = 2 THEN if(id % 2 = 0, 0D, -0D) ELSE double(id) END AS x", "cast(id % 3 AS double) AS y")
    scorer, forests = anomalies._scorer, []
    monkeypatch.setattr(anomalies, "_scorer", lambda trees, sample: forests.append(trees) or scorer(trees, sample))
    for bits in (0, 6, 20):  # one bucket holds all rows, so that all values are counted
        monkeypatch.setattr(anomalies, "MOST_BUCKETS", bits)
        anomalies.isolation_forest(df, ["x", "y"], trees=8, sample=64)
    assert len(forests[0]) == 8 and forests[0] == forests[1] == forests[2]


def test_sql_keeps_all_rows(spark):
    assert aggregate.sql_query(spark.range(150_000).toDF("i"), "SELECT i FROM df").count() == 150_000


def test_interpolation_methods(spark):
    rows = [(1, None), (2, 10.0), (3, None), (4, None), (10, 26.0), (11, None)]
    df = spark.createDataFrame(rows, "i int, v double")
    want = {"linear": [None, 10.0, 15.333333, 20.666667, 26.0, 26.0], "time": [None, 10.0, 12.0, 14.0, 26.0, 26.0], "nearest": [None, 10.0, 10.0, 26.0, 26.0, 26.0],
            "previous": [None, 10.0, 10.0, 10.0, 26.0, 26.0], "next": [10.0, 10.0, 26.0, 26.0, 26.0, None]}
    for method, values in want.items():
        out = missing.fill_missing_interpolate(df, "v", "i", method=method).orderBy("i").collect()
        assert [None if r.v is None else round(r.v, 6) for r in out] == values, method


def test_integrity_of_keys(spark):
    df = spark.range(100).selectExpr("id AS order_id", "if(id % 10 = 0, null, if(id % 10 = 1, -1, id % 20)) AS parent_id")
    got = {(r.type, r.column, r.ref_column): r["count"] for r in compare.referential_integrity(df).collect()}
    assert got == {("null_fk", "parent_id", None): 10, ("orphaned_fk", "parent_id", "order_id"): 10}
    assert compare.referential_integrity(df.limit(0)).count() == 0


def test_names_are_split_into_words():
    assert name_words("Unit Price (USD)") == ["unit", "price", "usd"]
    assert name_words("customerIDNumber", by_case=True) == ["customer", "id", "number"]
