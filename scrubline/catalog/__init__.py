"""Query catalogue: importing it registers all queries."""

from .. import operators  # noqa: F401
from . import (  # noqa: F401
    aggregates,
    anomalies,
    comparing,
    dedup,
    learning,
    missing,
    numbers,
    privacy,
    profiling,
    programs,
    projections,
    rows,
    sources,
    texts,
    times,
    validation,
    windows,
)
from .base import QUERIES, SQL  # noqa: F401

# conditional counts are 128-bit and bare fractions decimal in the SQL engine;
# the result columns are brought to the types Spark gives
_RESULT_TYPES = {
    "security_summary": {"failures": "BIGINT", "suspicious": "BIGINT"},
    "detect_outliers_iqr": {"outlier_count": "BIGINT"},
    "detect_outliers_zscore": {"outlier_count": "BIGINT"},
    "text_anomalies": {"count": "BIGINT"},
    "timeseries_summary": {"anomaly_count": "BIGINT"},
    "audit_step": {"cells_changed": "BIGINT"},
    "integrity_between": {"null_fk": "BIGINT", "orphan_fk": "BIGINT"},
    "referential_integrity": {"count": "BIGINT"},
    "duplicate_report": {"duplicate_groups": "BIGINT"},
    "learn_rules": {"success_rate": "DOUBLE"},
    "detect_pii": {"match_count": "BIGINT"},
    "pii_counts_in_text": {"rows": "BIGINT"},
    "profile_text_columns": {"whitespace": "BIGINT", "numeric_like": "BIGINT"},
    "detect_issues": {"count": "BIGINT"},
    "detect_encoding": {"hits": "BIGINT"},
    "auto_clean_explained": {"cells_changed": "BIGINT"},
    "quality_by_window": {"value_missing": "BIGINT"},
    "stream_quality": {"value_missing": "BIGINT"},
    "run_validation": {"violations": "BIGINT"},
    "pattern_validate": {"matches": "BIGINT"},
}
for _name, _types in _RESULT_TYPES.items():
    _casts = ", ".join(f'CAST("{c}" AS {kind}) AS "{c}"' for c, kind in _types.items())
    SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({SQL[_name]})"
