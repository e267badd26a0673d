"""Pipelines whose steps may fail on the data without ending the run."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..core import as_list, col
from .cut import cut
from .pipeline import _switched_off, apply_transformation, is_row_wise

#: signs that the cluster failed and not the step
CLUSTER_FAULTS = ("ExecutorLostFailure", "FetchFailed", "OutOfMemory", "No space left on device", "SparkContext was shut down", "cancelled")


def _marks(df: DataFrame, keys: list[str]) -> list[Column]:
    """Rows, and for each column a sum of hashes that tells whether its values are the same."""
    by = [col(k) for k in keys if k in df.columns]
    sums = []
    for i, field in enumerate(df.schema):
        kind = field.dataType.simpleString()
        # maps and variants have no hash; their text has one
        value = F.to_json(F.struct(col(field.name))) if "map<" in kind or "variant" in kind else col(field.name)
        # a hash passes over nulls, so they are told by a flag
        sums.append(F.sum(F.xxhash64(*by, value, value.isNull()).cast("decimal(38,0)")).alias(f"h{i}"))
    return [F.count(F.lit(1)).alias("rows"), *sums]


def _state(df: DataFrame, seen: dict) -> dict:
    return {"rows": seen["rows"], "columns": {f.name: (f.dataType.simpleString(), seen[f"h{i}"]) for i, f in enumerate(df.schema)}}


def _observed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, *_marks(df, keys)), seen


def _report(index: int, action: str, before: dict, after: dict) -> dict:
    old, new = before["columns"], after["columns"]
    same_rows = before["rows"] == after["rows"]
    return {
        "index": index, "action": action, "rows_before": before["rows"], "rows_after": after["rows"],
        "columns_added": [c for c in new if c not in old], "columns_removed": [c for c in old if c not in new],
        "columns_changed": [c for c in old if c in new and not (same_rows and old[c] == new[c])],
    }


def _segments(steps: list[tuple[int, str, dict]]):
    """Row-wise steps that follow each other go together; any other step is alone."""
    run = []
    for step in steps:
        if is_row_wise(step[1]):
            run.append(step)
            continue
        if run:
            yield run
        yield [step]
        run = []
    if run:
        yield run


def _told(error: Exception) -> str:
    """The error's text, unless the cluster and not the step is at fault."""
    text = str(error)
    if any(sign in text for sign in CLUSTER_FAULTS):
        raise error
    return text


def run_isolated(df: DataFrame, steps: list[dict], config: dict | None = None, start_from_step: int = 0, dry_run: bool = False,
                 stop_on_error: bool = False, keys=None) -> dict:
    """Run the steps ``{action, params}`` for good, going on from the last good state when one fails.

    Neighbouring row-wise steps run as one job that observes the table after every
    step; other steps run as a job of their own, so that their statistics read
    the state before them and not all earlier steps.  Each job ends in a cut.  If
    a job of several steps fails on the data, its steps are run one by one, and
    the failing ones are left out.  A fault of the cluster is raised.

    Without any step to run nothing is read, and ``rows_after`` is None.
    ``steps_run`` tells rows before and after each step and the columns that it added,
    removed and changed.  A column counts as changed if the number of rows, its type or the
    values that it holds differ; with ``keys``, also if the same values moved
    to other rows.  Tasks that run again after a lost executor may be observed
    twice, which shows as more rows and changed columns, never as fewer; the
    table itself is not touched by that.  On a dry run ``df`` is the input and all the rest is told.
    """
    off_actions, off_indices = _switched_off(config or {})
    keys = as_list(keys)
    wanted, skipped, ran, errors = [], [], [], []
    for index, step in enumerate(steps):
        off = index < start_from_step or index in off_indices or step["action"] in off_actions
        skipped.append(index) if off else wanted.append((index, step["action"], step.get("params", {})))

    if not wanted:
        return {"df": df, "steps_run": [], "steps_skipped": skipped, "errors": [], "success": True, "rows_after": None, "columns_after": df.columns}
    current, seen = _observed(df, keys)
    current = cut(current)
    state = _state(df, seen.get)

    def attempt(part):
        """State after all steps of the part and a report of each; raises if one of them fails."""
        now, marks = current, []
        for _, action, params in part:
            now, seen = _observed(apply_transformation(now, action, params), keys)
            marks.append((now, seen))
        now = cut(now)
        states = [_state(d, s.get) for d, s in marks]
        told = [_report(i, a, b, s) for (i, a, _), b, s in zip(part, [state, *states], states)]
        return now, states[-1], told

    for segment in _segments(wanted):
        parts = [segment]
        while parts:
            part = parts.pop(0)
            try:
                current, state, told = attempt(part)
            except (PySparkException, ValueError, TypeError, KeyError) as error:
                text = _told(error)
                if len(part) > 1:
                    parts = [[step] for step in part]
                    continue
                errors.append({"index": part[0][0], "action": part[0][1], "error": text})
                if stop_on_error:
                    break
            else:
                ran += told
        if errors and stop_on_error:
            break
    return {"df": df if dry_run else current, "steps_run": ran, "steps_skipped": skipped, "errors": errors, "success": not errors,
            "rows_after": state["rows"], "columns_after": list(state["columns"])}
