"""Named actions folded into one plan, with step control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ACTIONS, col
from ..operators.compare import audit_step

# --- fixed values: step groups a configuration can switch off ------------------
STEP_GROUPS = {
    "dedup": {"remove_duplicates", "fuzzy_remove_duplicates"},
    "clean": {"trim_whitespace", "standardise_capitalisation", "normalise_categories", "fill_missing", "coerce_numeric"},
    "profile": set(),
}
# --- end of fixed values -------------------------------------------------------


def apply_transformation(df: DataFrame, action: str, params: dict | None = None) -> DataFrame:
    """Run one named action; an unknown name raises."""
    if action not in ACTIONS:
        raise ValueError(f"Unknown cleaning action: '{action}'")
    return ACTIONS[action].function(df, **(params or {}))


def is_row_wise(action: str) -> bool:
    return action in ACTIONS and ACTIONS[action].row_wise


def _switched_off(config: dict) -> tuple[set, set]:
    actions = set().union(*[group for name, group in STEP_GROUPS.items() if config.get(name) is False])
    off = [s for s in config.get("steps", []) if s.get("enabled") is False]
    return actions | {s["action"] for s in off if "action" in s}, {s["index"] for s in off if "index" in s}


def run_pipeline(df: DataFrame, steps: list[dict], config: dict | None = None, start_from_step: int = 0,
                 dry_run: bool = False, stop_on_error: bool = False, keys=None) -> dict:
    """Fold the steps ``{action, params}`` over the table.

    A step that fails when it is planned is recorded and skipped (or ends the
    run).  The result holds ``df`` (the input on a dry run), ``steps_run``,
    ``steps_skipped``, ``errors``, ``success`` and, with ``keys``, ``audit``: a
    list of lazy one-row change reports.
    """
    off_actions, off_indices = _switched_off(config or {})
    current, ran, skipped, errors, audit = df, [], [], [], []
    for index, step in enumerate(steps):
        action, params = step["action"], step.get("params", {})
        if index < start_from_step or index in off_indices or action in off_actions:
            skipped.append(index)
            continue
        try:
            after = apply_transformation(current, action, params)
            names = after.columns  # forces analysis
        except Exception as error:  # noqa: BLE001 - one bad step must not end the run
            errors.append({"index": index, "action": action, "error": str(error)})
            if stop_on_error:
                break
            continue
        ran.append({
            "index": index, "action": action,
            "columns_added": [c for c in names if c not in current.columns],
            "columns_removed": [c for c in current.columns if c not in names],
        })
        if keys:
            audit.append(audit_step(current, after, action, keys))
        current = after
    result = {"df": df if dry_run else current, "steps_run": ran, "steps_skipped": skipped, "errors": errors,
              "success": not errors, "audit": audit}
    if dry_run:
        result["rows_after"] = current.count()
        result["columns_after"] = current.columns
    return result


def run_single_step(df: DataFrame, steps: list[dict], index: int) -> DataFrame:
    if not 0 <= index < len(steps):
        raise IndexError(f"step {index} does not exist")
    return apply_transformation(df, steps[index]["action"], steps[index].get("params", {}))


def batch_clean(tables: dict[str, DataFrame], steps: list[dict]) -> tuple[dict[str, DataFrame], list[dict]]:
    """The same steps on many tables: cleaned tables and one status line each."""
    cleaned, status = {}, []
    for name, table in tables.items():
        result = run_pipeline(table, steps)
        cleaned[name] = result["df"]
        status.append({"dataset": name, "success": result["success"], "steps": len(result["steps_run"]),
                       "errors": [e["error"] for e in result["errors"]]})
    return cleaned, status


def stack(tables: dict[str, DataFrame]) -> DataFrame:
    """One long table with a ``dataset`` column, missing columns null."""
    parts = [t.withColumn("dataset", F.lit(n)) for n, t in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.select("dataset", *[col(c) for c in out.columns if c != "dataset"])
