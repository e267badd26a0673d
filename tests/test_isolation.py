"""Pipelines with steps that fail only on the data."""

import pytest

from scrubline.core import ACTIONS, Action
from scrubline.plans import isolation


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, f" name {i % 3} ", i % 5, None if i % 4 else float(i)) for i in range(200)]
    return spark.createDataFrame(rows + rows[:20], "id int, name string, n int, v double").repartition(3)


@pytest.fixture(autouse=True)
def odd_actions():
    """A row-wise step that divides by zero in some rows, and one that counts how often it is planned."""
    ACTIONS["test_divide"] = Action("test_divide", lambda d, **_: d.selectExpr("*", "100 div n AS part"), True)
    ACTIONS["test_swap"] = Action("test_swap", lambda d, **_: d.selectExpr("id", "name", "4 - n AS n", "v"), True)
    yield
    del ACTIONS["test_divide"], ACTIONS["test_swap"]


def step(action, **params):
    return {"action": action, "params": params}


def test_a_step_that_fails_on_data_is_left_out(df):
    steps = [step("trim_whitespace"), step("test_divide"), step("remove_duplicates"), step("no_such_action"), step("fill_missing", column="v", strategy="zero")]
    out = isolation.run_isolated(df, steps)
    assert [e["index"] for e in out["errors"]] == [1, 3] and not out["success"]
    assert "DIVIDE_BY_ZERO" in out["errors"][0]["error"]
    assert [r["index"] for r in out["steps_run"]] == [0, 2, 4]
    rows = out["df"].collect()
    assert len(rows) == 200 == out["rows_after"] and {r.name for r in rows} == {"name 0", "name 1", "name 2"} and all(r.v is not None for r in rows)
    by = {r["index"]: r for r in out["steps_run"]}
    assert by[0]["columns_changed"] == ["name"] and by[0]["rows_before"] == by[0]["rows_after"] == 220
    assert by[2]["rows_after"] == 200 and by[4]["columns_changed"] == ["v"]


def test_stop_on_error_keeps_the_last_good_state(df):
    out = isolation.run_isolated(df, [step("trim_whitespace"), step("test_divide"), step("remove_duplicates")], stop_on_error=True)
    assert [r["index"] for r in out["steps_run"]] == [0] and out["df"].count() == 220


def test_dry_run_tells_changes_and_leaves_the_table(df):
    out = isolation.run_isolated(df, [step("trim_whitespace"), step("remove_duplicates"), step("trim_whitespace")], dry_run=True, start_from_step=0,
                                 config={"steps": [{"index": 2, "enabled": False}]})
    assert out["df"] is df and out["rows_after"] == 200 and out["steps_skipped"] == [2] and out["columns_after"] == df.columns
    assert out["steps_run"][0]["columns_changed"] == ["name"] and out["steps_run"][1]["columns_changed"] == df.columns


def test_values_that_move_are_told_by_key(df):
    few = df.dropDuplicates(["id"])
    assert isolation.run_isolated(few, [step("test_swap")])["steps_run"][0]["columns_changed"] == []
    assert isolation.run_isolated(few, [step("test_swap")], keys="id")["steps_run"][0]["columns_changed"] == ["n"]


def test_a_fault_of_the_cluster_is_raised():
    with pytest.raises(ValueError):
        isolation._told(ValueError("ExecutorLostFailure (executor 3 exited)"))


def test_empty_table_and_no_steps(df):
    out = isolation.run_isolated(df.limit(0), [step("trim_whitespace")])
    assert out["success"] and out["rows_after"] == 0 and out["steps_run"][0]["columns_changed"] == []
    assert isolation.run_isolated(df, [])["df"] is df
