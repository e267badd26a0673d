"""Single operators on small literal tables."""

import re

import pytest
from pyspark.sql import functions as F

from scrubline import operators  # noqa: F401
from scrubline.functions import stats
from scrubline.functions import values as fixed
from scrubline.operators import aggregate, anomalies, dates, issues, lineage, missing, numeric, privacy, profile, rows, schema, text, validate, windows
from scrubline.operators.fields import domain_clean
from scrubline.plans import pipeline, programs


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(
        [("  Alice ", 30.0, 50000.0, "alice@x.com", "new york"), ("bob", None, 60000.0, "bad", "New York"), ("  alice", 25.0, 55000.123456, "a@b.co", "NEW YORK"),
         (None, 40.0, 70000.0, None, "Boston"), ("Dave", 35.0, 9999999.0, "d@d.org", "boston")],
        "name string, age double, salary double, email string, city string")


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_trim_title_categories(messy):
    out = text.trim_whitespace(messy)
    assert set(column(out, "name")) == {"Alice", "bob", "alice", None, "Dave"}
    assert set(column(text.standardise_capitalisation(out), "city")) == {"New York", "Boston"}
    assert len(set(column(text.normalise_categories(messy, "city"), "city"))) == 2
    # applying it twice changes nothing
    assert sorted(map(str, text.trim_whitespace(out).collect())) == sorted(map(str, out.collect()))


def test_title_matches_python(spark):
    words = ["they're bill's", "o'NEIL-smith", "a1b2 c_d", "école DES ponts", "", "x"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert column(text.standardise_capitalisation(df), "w") == [w.title() for w in words]


def test_fill_and_coerce(spark, messy):
    assert missing.fill_missing(messy, "age", "median").where("age is null").count() == 0
    assert 32.5 in column(missing.fill_missing(messy, "age", "median"), "age")
    mixed = spark.createDataFrame([("1",), ("abc",), ("12d",), ("1e3",), (None,)], "v string")
    assert column(schema.coerce_numeric(mixed, "v"), "v") == [1.0, None, None, 1000.0, None]


def test_clip_and_constant(spark):
    df = spark.createDataFrame([(float(v), "x") for v in (1, 2, 3, 4, 100)], "value double, same string")
    assert max(column(numeric.clip_outliers(df, "value"), "value")) < 100
    assert schema.drop_constant_columns(df).columns == ["value"]


def test_box_cox_lambda(spark):
    # brute force over a fine grid of exponents
    import numpy as np

    df = spark.range(1, 400).selectExpr("double(id * id) AS v")
    lam = numeric.box_cox_lambda(df, "v", 0.0)
    x = np.arange(1, 400, dtype=float) ** 2

    def likelihood(p):
        return -len(x) / 2 * np.log(((x**p - 1) / p).var()) + (p - 1) * np.log(x).sum()

    grid = np.arange(0.05, 1.5, 0.0005)
    assert lam == pytest.approx(grid[np.argmax([likelihood(p) for p in grid])], abs=2e-3)
    assert numeric.box_cox_transform(df, "v").where("v_boxcox is null").count() == 0


def test_bins_and_labels(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    found = {r.v: r.v_bin for r in numeric.bin_numeric(df, "v", 2).collect()}
    assert found[0.0] == found[5.0] == "(-0.01, 5.0]" and found[10.0] == "(5.0, 10.0]"


@pytest.mark.parametrize("limit, sketch", [(10, 20), (30, 50), (50_000, 10_000)])
def test_quantiles_equal_exact_percentiles(spark, limit, sketch):
    df = spark.range(1000).selectExpr("double(id * 7919 % 1009) AS v", "IF(id % 3 = 0, 5.0D, double(id)) AS w")
    probs = [0.0, 0.05, 0.5, 0.731, 1.0]
    want = df.agg(F.percentile("v", probs), F.percentile("w", probs)).first()
    got = stats.quantiles(df, {"v": F.col("v"), "w": F.col("w")}, probs, limit, sketch)
    for name, exact in zip("vw", want):
        assert got[name] == pytest.approx(exact)


def test_grouped_quantile(spark):
    df = spark.range(2000).selectExpr("id % 7 AS g", "double(id * 31 % 997) AS v")
    got = {r.g: r.q for r in stats.grouped_quantile(df, ["g"], F.col("v"), 0.5).collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == pytest.approx(want)


def test_ordered_operators_do_not_depend_on_buckets(spark):
    df = spark.range(600).selectExpr("id", "IF(id % 100 < 40, 0, id % 5) AS k", "IF(id % 4 = 0, NULL, double(id * 37 % 101)) AS v").repartition(5)

    def runs(make):
        return [sorted(map(tuple, make(n).collect()), key=str) for n in (None, 50, 23)]

    for partition in (None, "k"):
        for make in (
            lambda n: missing.fill_missing_ffill(df, "v", "id", partition, n),
            lambda n: missing.fill_missing_bfill(df, "v", "id", partition, n),
            lambda n: windows.lag_column(df, "v", 3, partition_by=partition, order_by="id", rows_per_bucket=n),
            lambda n: windows.lead_column(df, "v", 2, partition_by=partition, order_by="id", rows_per_bucket=n),
            lambda n: windows.cumulative_stats(df, "v", ["sum", "max", "min", "count"], None, partition, "id", n),
        ):
            a, b, c = runs(make)
            assert a == b == c
    a, b, _c = runs(lambda n: windows.rolling_stats(df, "v", 4, ["sum"], "k", "id", n))
    assert a == b


def test_date_layouts(spark):
    cases = {
        "2024-01-07": "2024-01-07", "07/01/2024": "2024-01-07", "1/15/2024": "2024-01-15", "7.1.2024": "2024-01-07", "Jan 7, 2024": "2024-01-07", "7 january 2024": "2024-01-07",
        "2024/01/07 10:30": "2024-01-07", "20240107": "2024-01-07", "1704585600": "2024-01-07", "1704585600000": "2024-01-07", "soon": None, "2024-13-45": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string").withColumn("raw", F.col("d"))
    got = {r.raw: r.d for r in dates.standardise_dates(df, "d").collect()}
    assert got == cases


def test_validation_rules(messy):
    found = {r.rule: r.violations for r in validate.run_validation(messy, [
        {"type": "not_null", "column": "name"}, {"type": "range", "column": "age", "min": 26, "max": 50}, {"type": "unique", "column": "city"},
        {"type": "predicate", "expression": "salary < 100000"}, {"type": "nonsense", "column": "name"}]).collect()}
    assert found == {"not_null:name": 1, "range:age": 2, "unique:city": 0, "predicate": 1, "nonsense:name": 0}
    assert validate.violation_samples(messy, {"type": "not_null", "column": "name"}).count() == 1


def test_named_patterns_agree_with_python(spark):
    examples = ["GB82WEST12345698765432", "user@example.com", "AA:BB:CC:DD:EE:FF", "SW1A 1AA", "2024-01-15T14:30:00Z", "550e8400-e29b-41d4-a716-446655440000", "$1,234.56", "é4111 1111 1111 1111 ó"]
    df = spark.createDataFrame([(e,) for e in examples], "t string")
    got = {r.pattern_name: r.matches for r in validate.pattern_validate(df, "t").collect()}
    assert len(got) == 54
    for name, pattern in fixed.PATTERNS.items():
        assert got[name] == sum(bool(re.search(pattern, e)) for e in examples), name


def test_masking_in_text_agrees_with_python(spark):
    raw = "card 4111 1111 1111 1111 óver, ssn 123-45-6789, mail a.b@c.org, ip 10.0.0.1."
    got = privacy.mask_pii_in_text(spark.createDataFrame([(raw,)], "t string"), "t", ["email", "credit_card", "ssn", "ip_address"]).first().t
    want = raw
    for kind in ("email", "credit_card", "ssn", "ip_address"):
        want = re.sub(fixed.PII_PATTERNS[kind], fixed.REDACTION_LABELS[kind], want)
    assert got == want
    masked = privacy.mask_pii(spark.createDataFrame([("x",), ("",), (None,)], "t string"), "t", "email", "fake")
    assert [r.t is None or "@" in r.t or r.t == "" for r in masked.collect()] == [True] * 3


def test_domain_fields(spark):
    df = spark.createDataFrame([("123-45-6789", "type AB+ pos", "aspirin  PLUS", " ", "03/04/1990")], "ssn string, blood_group string, medication string, icd_code string, dob string")
    r = domain_clean(df, "healthcare").first()
    assert (r.ssn, r.blood_group, r.medication, r.icd_code) == ("***-**-6789", "AB+", "Aspirin Plus", None)
    df = spark.createDataFrame([("disagree", "very unsatisfied", "Y", "55"), ("strongly agree", "happy", "nope", "101"), ("7", "meh", "maybe", "x")],
                               "rating string, satisfaction string, yes_no string, nps string")
    got = [tuple(r) for r in domain_clean(df, "survey").collect()]
    assert got == [(2, "Very Unsatisfied", "Yes", 55), (5, "Satisfied", "No", None), (7, "Meh", "Maybe", None)]
    df = spark.createDataFrame([("6'2\"", "80 kg", "pg", "105"), ("188cm", "12 stone", "zz", "7")], "height string, weight string, position string, jersey_number string")
    got = domain_clean(df, "sports").collect()
    assert got[0].height == 74 and round(got[1].height, 2) == 74.02 and round(got[0].weight, 4) == 176.3696 and got[1].weight == 168
    assert (got[0].position, got[1].position, got[0].jersey_number) == ("Point Guard", "ZZ", 5)
    assert domain_clean(df, "unknown thing").columns == df.columns


def test_scores_and_issues(spark, messy):
    clean = spark.createDataFrame([(f"N{i}", i, f"n{i}@a.org") for i in range(20, 30)], "name string, age int, email string")
    dirty = spark.createDataFrame([("A", 1.0, "bad", "x"), ("A", 1.0, "bad", "x"), (None, -5.0, None, "x"), ("b", None, "q@", "x")], "name string, age double, email string, const string")
    high, low = issues.health_score(clean).first(), issues.health_score(dirty).first()
    assert 0 <= low.score < high.score <= 100 and high.grade == "A"
    found = {r.type for r in issues.detect_issues(dirty).collect()}
    assert {"duplicate_rows", "constant_column", "negative_in_positive_col", "missing_values", "invalid_email"} <= found
    assert issues.detect_issues(clean).where("severity = 'high'").count() == 0


def test_formula_guard(messy):
    assert schema.formula_column(messy, "x", "salary / nullif(age, 0)").columns[-1] == "x"
    for bad in ("java_method('java.lang.System', 'exit')", "(SELECT 1)", "reflect('a','b')", "1; drop table x"):
        with pytest.raises(ValueError):
            schema.formula_column(messy, "x", bad)
    for bad in ("DROP TABLE df", "SELECT 1; SELECT 2", "INSERT INTO df VALUES (1)"):
        with pytest.raises(ValueError):
            aggregate.sql_query(messy, bad)


def test_pipeline_control(messy):
    steps = [{"action": "trim_whitespace"}, {"action": "remove_duplicates"}, {"action": "bogus"}, {"action": "drop_column", "params": {"column": "email"}}]
    run = pipeline.run_pipeline(messy, steps)
    assert [s["index"] for s in run["steps_run"]] == [0, 1, 3] and run["errors"][0]["index"] == 2 and not run["success"]
    assert pipeline.run_pipeline(messy, steps, stop_on_error=True)["steps_run"][-1]["index"] == 1
    run = pipeline.run_pipeline(messy, steps, {"dedup": False, "steps": [{"index": 0, "enabled": False}]}, start_from_step=0)
    assert run["steps_skipped"] == [0, 1]
    dry = pipeline.run_pipeline(messy, steps, dry_run=True)
    assert dry["df"] is messy and dry["rows_after"] == 5 and "email" not in dry["columns_after"]
    with pytest.raises(ValueError):
        pipeline.apply_transformation(messy, "bogus")


def test_programs(messy):
    smart = programs.smart_auto_clean(messy)
    assert not smart["errors"] and smart["df"].count() == 5
    assert programs.smart_auto_clean(messy, dry_run=True)["df"] is messy
    cleaned, scores = programs.deep_clean(messy)
    assert cleaned.count() == 5 and scores.count() == 2


def test_isolation_forest_finds_the_far_points(spark):
    df = spark.range(500).selectExpr("id", "IF(id < 5, 1000.0 + id, double(id * 13 % 50)) AS v", "double(id % 7) AS w")
    out = anomalies.isolation_forest(df, ["v", "w"], contamination=0.02, trees=40)
    assert {r.id for r in out.where("is_anomaly").collect()} >= set(range(5))


def test_lineage(spark):
    nodes, edges = lineage.record_lineage(spark, [{"action": "merge", "before": ["a", "b"], "after": ["c"], "mapping": {"c": ["a", "b"]}}, {"action": "trim", "before": ["c"], "after": ["c"]}], ["a", "b"])
    assert {r.node for r in lineage.column_lineage(edges, "2:c").collect()} == {"2:c", "1:c", "0:a", "0:b"}
    assert {r.node for r in lineage.impact_analysis(edges, "0:a").collect()} == {"0:a", "1:c", "2:c"}
    assert nodes.count() == 4


def test_sampling_is_stable(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS g")
    first = {r.id for r in rows.sample_random(df, 20, keys="id").collect()}
    assert first == {r.id for r in rows.sample_random(df.repartition(7), 20, keys="id").collect()}
    assert all(r["n"] == 4 for r in rows.sample_stratified(df, "g", 4, keys="id").groupBy("g").agg(F.count("*").alias("n")).collect())


def test_plans_stay_native(spark):
    df = spark.range(10).selectExpr("string(id) AS a", "double(id) AS v", "id")
    for out in (text.trim_whitespace(df), text.standardise_capitalisation(df), dates.standardise_dates(df, "a"), numeric.clip_outliers(df, "v"), profile.profile_dataset(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
    plan = windows.lag_column(df, "v", order_by="id", rows_per_bucket=3)._jdf.queryExecution().executedPlan().toString()
    # only the per-bucket totals (512 rows at most) may meet in one partition
    lines = plan.splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert all("HashAggregate(keys=[_bucket" in lines[i + 1] for i in single)
