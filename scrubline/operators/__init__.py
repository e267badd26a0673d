"""Table operators: ``op(df, **params) -> DataFrame``.

Importing this package fills the action registry.
"""

from . import (  # noqa: F401
    aggregate,
    anomalies,
    compare,
    dates,
    dedup,
    fields,
    issues,
    lineage,
    missing,
    model,
    numeric,
    privacy,
    profile,
    rows,
    schema,
    text,
    validate,
    windows,
)
