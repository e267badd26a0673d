"""Issue detection, scores and recommended fixes."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import batches, col, is_numeric, is_string, is_temporal, one_row, string_columns
from ..functions import values as fixed
from ..functions.dates import as_timestamp
from ..functions.numbers import to_number
from ..functions.text import strip
from .profile import duplicate_report, per_column, union_all

# --- fixed values ------------------------------------------------------------
DATE_LAYOUTS = [
    r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}-\d{2}-\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}/\d{2}/\d{2}$",
    r"^\d{1,2}\.\d{1,2}\.\d{4}$", r"^[A-Za-z]+ \d{1,2},? \d{4}$", r"^\d{1,2} [A-Za-z]+ \d{4}$",
]
FIXES = {
    "duplicate_rows": "remove_duplicates", "all_null_column": "drop_column", "constant_column": "drop_column",
    "missing_values": "fill_missing", "negative_in_positive_col": "clip_outliers", "empty_string_values": "find_replace",
    "encoding_garbage": "strip_characters", "likely_id_column": "drop_column", "extra_whitespace": "trim_whitespace",
    "capitalisation_inconsistency": "standardise_capitalisation", "invalid_email": "flag_invalid_emails",
    "invalid_phone": "normalize_phone", "mixed_data_types": "coerce_numeric",
    "category_inconsistency": "normalise_categories", "date_out_of_range": "standardise_dates",
    "mixed_date_formats": "standardise_mixed_dates", "unparseable_dates": "standardise_mixed_dates",
}
# issue -> (category, penalty per column, cap, multiplier of the affected share or None)
PENALTIES = {
    "empty_string_values": ("Completeness", 3.0, 8.0, None), "all_null_column": ("Completeness", 8.0, 30.0, None),
    "constant_column": ("Structural", 4.0, 12.0, None), "encoding_garbage": ("Structural", 4.0, 10.0, None),
    "likely_id_column": ("Structural", 1.5, 4.0, None), "invalid_email": ("Format", 0.0, 6.0, 6.0),
    "invalid_phone": ("Format", 0.0, 4.0, 4.0), "category_inconsistency": ("Format", 2.5, 6.0, None),
    "capitalisation_inconsistency": ("Format", 1.0, 3.0, None), "extra_whitespace": ("Format", 0.5, 2.0, None),
    "mixed_data_types": ("Type", 4.0, 10.0, None), "negative_in_positive_col": ("Type", 0.0, 5.0, 5.0),
    "date_out_of_range": ("Date", 0.0, 6.0, 6.0), "mixed_date_formats": ("Date", 3.5, 6.0, None),
    "unparseable_dates": ("Date", 0.0, 5.0, 5.0), "outlier": ("Anomalies", 0.0, 8.0, 8.0),
    "anomaly": ("Anomalies", 0.0, 8.0, 8.0),
}
SEVERITY = {"high": 1.0, "medium": 0.6, "low": 0.25}
# issue -> (priority, action, parameters, confidence)
RECOMMENDED = {
    "duplicate_rows": ("high", "remove_duplicates", "", 0.95),
    "missing_values": ("high", "fill_missing", "strategy=mode", 0.85),
    "extra_whitespace": ("low", "trim_whitespace", "", 0.90),
    "capitalisation_inconsistency": ("medium", "standardise_capitalisation", "strategy=title", 0.80),
    "invalid_email": ("medium", "flag_invalid_emails", "", 0.90),
    "invalid_phone": ("medium", "normalize_phone", "", 0.85),
    "mixed_data_types": ("high", "coerce_numeric", "", 0.75),
    "category_inconsistency": ("medium", "normalise_categories", "", 0.80),
    "all_null_column": ("high", "drop_column", "", 0.95),
    "mixed_date_formats": ("high", "standardise_mixed_dates", "dayfirst=True", 0.70),
    "unparseable_dates": ("medium", "standardise_mixed_dates", "dayfirst=True", 0.70),
    "constant_column": ("medium", "drop_constant_columns", "", 0.90),
    "empty_string_values": ("medium", "map_values", "", 0.85),
    "negative_in_positive_col": ("high", "clip_outliers", "method=iqr", 0.80),
    "encoding_garbage": ("medium", "strip_characters", "mode=non_printable", 0.85),
    "likely_id_column": ("low", "drop_column", "", 0.70),
    "date_out_of_range": ("medium", "standardise_dates", "", 0.75),
    "outliers": ("medium", "clip_outliers", "method=iqr", 0.75),
    "high_missing": ("high", "drop_high_missing_columns", "threshold=0.5", 0.90),
    "sentinel_values": ("high", "map_values", "", 0.85),
    "whitespace": ("low", "trim_whitespace", "", 0.90),
    "mixed_case": ("medium", "standardise_capitalisation", "strategy=lower", 0.80),
}
# --- end of fixed values -----------------------------------------------------

_GARBAGE = r"[\p{C}\p{Zl}\p{Zp}&&[^\n\r\t]]|[\p{Zs}&&[^ ]]"


def _spellings(df: DataFrame, name: str) -> DataFrame:
    """Distinct raw, stripped and normal forms of a text column, by nested counting."""
    raw = df.where(col(name).isNotNull()).select(col(name).alias("raw")).distinct()
    stripped = raw.groupBy(strip(F.col("raw")).alias("s")).agg(F.count("*").alias("raws"))
    normal = stripped.groupBy(F.lower("s").alias("k")).agg(F.sum("raws").alias("raws"), F.count("*").alias("strips"))
    return normal.agg(F.coalesce(F.sum("raws"), F.lit(0)).alias("raw"), F.coalesce(F.sum("strips"), F.lit(0)).alias("stripped"),
                      F.count("*").alias("normal")).select(F.lit(name).alias("_c"), "raw", "stripped", "normal")


def detect_issues(df: DataFrame, with_duplicates: bool = True) -> DataFrame:
    """``(type, severity, count, column, fix_action)``: 17 checks over the whole table.

    One wide aggregate counts everything that needs a single row; spelling
    variants come from nested distinct counts per text column.
    """
    names = df.columns
    last_year = datetime.date.today().year + 5

    def any_word(name, words):
        return any(w in name.lower() for w in words)

    def make(name: str) -> dict[str, Column]:
        c, text = col(name), col(name).cast("string")
        is_text, number = is_string(df, name), to_number(c, is_numeric(df, name))
        no = F.lit(False)
        dated = any_word(name, fixed.DATE_WORDS) and (is_text or is_temporal(df, name))
        stamp = as_timestamp(df, name, True) if dated else None
        positive = is_numeric(df, name) and any_word(name, fixed.POSITIVE_WORDS)
        layouts = [F.count_if(strip(text).rlike(p)) if dated and is_text else F.count_if(no) for p in DATE_LAYOUTS]
        return {
            "rows": F.count("*"), "filled": F.count(c),
            "low": F.min(text), "high": F.max(text),
            "negative": F.count_if(number < 0) if positive else F.count_if(no),
            "blank": F.count_if(strip(text) == "") if is_text else F.count_if(no),
            "garbage": F.count_if(text.rlike(_GARBAGE)) if is_text else F.count_if(no),
            "untidy": F.count_if((text != strip(text)) | F.contains(text, F.lit("  "))) if is_text else F.count_if(no),
            "at": F.count_if(F.contains(text, F.lit("@"))) if is_text else F.count_if(no),
            "bad_email": F.count_if(~strip(text).rlike(fixed.EMAIL_PATTERN)) if is_text else F.count_if(no),
            "bad_phone": F.count_if(~strip(text).rlike(fixed.PHONE_PATTERN)) if is_text and any_word(name, ["phone", "mobile", "tel"]) else F.count_if(no),
            "numbers": F.count(number) if is_text else F.count_if(no),
            "out_of_range": F.count_if((F.year(stamp) < 1900) | (F.year(stamp) > last_year)) if dated else F.count_if(no),
            "unparsed": F.count_if(c.isNotNull() & stamp.isNull()) if dated else F.count_if(no),
            "layouts": reduce(lambda a, b: a + b, [(n > 0).cast("long") for n in layouts]),
            "in_layout": reduce(lambda a, b: a + b, layouts),
        }

    s = per_column(df, names, make, size=10)
    texts = string_columns(df)
    if texts:
        s = s.join(F.broadcast(union_all([_spellings(df, n) for n in texts])), F.col("column") == F.col("_c"), "left")
    else:
        s = s.withColumns({k: F.lit(None).cast("long") for k in ("raw", "stripped", "normal")})
    is_text = F.col("raw").isNotNull()
    filled, rows = F.col("filled"), F.col("rows")
    email_named = F.contains(F.lower("column"), F.lit("email"))
    empty = filled == 0
    constant = ~empty & (F.col("low") == F.col("high"))
    usable = ~empty & ~constant
    missing_pct = F.round((rows - filled) / rows * 100, 1)
    number_share = F.col("numbers") / filled

    def issue(kind: str, count: Column, found: Column, severity) -> Column:
        level = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(found, F.struct(
            F.lit(kind).alias("type"), level.alias("severity"), count.cast("long").alias("count"), F.col("column"),
            F.lit(FIXES[kind]).alias("fix_action")))

    def counted(kind: str, name: str, severity, extra: Column | None = None) -> Column:
        test = usable & (F.col(name) > 0)
        return issue(kind, F.col(name), test & extra if extra is not None else test, severity)

    checks = [
        issue("all_null_column", rows, empty & (rows > 0), "high"),
        issue("constant_column", filled, constant, "medium"),
        issue("missing_values", rows - filled, usable & (filled < rows),
              F.when(missing_pct > 20, "high").when(missing_pct > 5, "medium").otherwise("low")),
        counted("negative_in_positive_col", "negative", "high"),
        counted("empty_string_values", "blank", "medium"),
        counted("encoding_garbage", "garbage", "medium"),
        issue("likely_id_column", F.col("raw"), usable & is_text & (F.col("raw") / filled > 0.95) & (filled >= 20), "low"),
        counted("extra_whitespace", "untidy", "low"),
        issue("capitalisation_inconsistency", F.col("stripped") - F.col("normal"),
              usable & is_text & (F.col("normal") < F.col("stripped")) & (F.col("normal") >= 2), "medium"),
        counted("invalid_email", "bad_email", "medium", email_named | (F.col("at") / filled > 0.5)),
        counted("invalid_phone", "bad_phone", "medium"),
        issue("mixed_data_types", filled - F.col("numbers"), usable & is_text & (number_share > 0.05) & (number_share < 0.95), "high"),
        issue("category_inconsistency", F.col("raw") - F.col("normal"),
              usable & is_text & F.col("normal").between(2, 30) & (F.col("raw") > F.col("normal")), "medium"),
        counted("date_out_of_range", "out_of_range", "medium"),
        issue("mixed_date_formats", F.col("in_layout"), usable & (F.col("layouts") > 1), "high"),
        counted("unparseable_dates", "unparsed", F.when(F.round(F.col("unparsed") / filled * 100, 1) > 10, "high").otherwise("medium")),
    ]
    found = s.select(F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("i")).select("i.*")
    if not with_duplicates:
        return found
    copies = duplicate_report(df).where("duplicate_rows > 0").select(
        F.lit("duplicate_rows").alias("type"), F.lit("high").alias("severity"), F.col("duplicate_rows").alias("count"),
        F.lit(None).cast("string").alias("column"), F.lit("remove_duplicates").alias("fix_action"))
    return copies.unionByName(found)


def score_deductions(df: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """``(reason, category, points)`` of every capped penalty.

    Filled cells and duplicate rows are counted once, for the base penalties and
    for the shares of the issues.
    """
    issues = detect_issues(df, with_duplicates=False) if issues is None else issues
    counts = {}
    for part in batches(df.columns, 40):
        row = one_row(df, [F.count("*").alias("rows"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(part)]])
        counts |= {c: row[f"c{i}"] for i, c in enumerate(part)}
        rows = row["rows"]
    spark, missing = df.sparkSession, sum(rows - n for n in counts.values())
    filled = spark.createDataFrame(list(counts.items()), "column string, filled long")
    base = duplicate_report(df).select(F.inline(F.array(
        F.struct(F.lit("missing_values").alias("reason"), F.lit("Completeness").alias("category"),
                 F.lit(round(min(missing / (rows * len(counts)) * 30, 30.0), 2) if rows else None).cast("double").alias("points")),
        F.struct(F.lit("duplicate_rows").alias("reason"), F.lit("Duplicates").alias("category"),
                 F.round(F.least(F.try_divide("duplicate_rows", F.lit(rows)) * 20, F.lit(20.0)), 2).alias("points")))))
    config = df.sparkSession.createDataFrame(
        [(k, c, p, cap, m) for k, (c, p, cap, m) in PENALTIES.items()],
        "reason string, category string, penalty double, cap double, multiplier double")
    weight = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    kind = F.when(F.contains("type", F.lit("outlier")), "outlier").otherwise(F.col("type"))
    joined = issues.withColumn("reason", kind).join(F.broadcast(config), "reason").join(
        F.broadcast(filled.withColumnRenamed("column", "_c")), F.col("column") == F.col("_c"), "left")
    share = F.least(F.col("count") / F.greatest(F.coalesce("filled", F.lit(1)), F.lit(1)), F.lit(1.0))
    points = F.coalesce(share * F.col("multiplier"), F.col("penalty")) * F.coalesce(weight[F.col("severity")], F.lit(0.6))
    rest = joined.groupBy("reason", "category").agg(F.sum(points).alias("raw"), F.max("cap").alias("cap")).select(
        "reason", "category", F.round(F.least("raw", "cap"), 2).alias("points"))
    return base.unionByName(rest).where("points > 0")


def health_score(df: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One row: score 0-100 and grade A-F."""
    total = score_deductions(df, issues).agg(F.coalesce(F.sum("points"), F.lit(0.0)).alias("p"))
    score = F.greatest(F.lit(0.0), F.round(100 - F.col("p"), 1))
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return total.select(score.alias("score"), grade.alias("grade"))


def quality_score(df: DataFrame, issue_count: int = 0) -> DataFrame:
    """One row with two 0-100 scores: ``simple`` and ``weighted``.

    simple: missing share x 30, duplicate share x 20, 2 per known issue.
    weighted: also type mixes, format validity by column name and constant columns.
    """
    def make(name):
        text = col(name).cast("string")
        low = name.lower()
        if "email" in low:
            good = text.rlike(r"^[\w.-]+@[\w.-]+\.\w+$")
        elif any(w in low for w in ("phone", "tel", "mobile")):
            good = text.rlike(r"^[\d\s\-\(\)\+]+$")
        elif "date" in low or "dob" in low:
            good = as_timestamp(df, name, False).isNotNull()
        elif "zip" in low or "postal" in low:
            good = text.rlike(r"^\d{5}(-\d{4})?$")
        else:
            good = None
        valid = F.try_divide(F.count_if(good), F.count(text)) if good is not None else F.when(F.count(text) > 0, 0.8)
        mixed = F.count_if(text.rlike(r"^-?\d+\.?\d*$")) if is_string(df, name) else F.count_if(F.lit(False))
        return {"rows": F.count("*"), "filled": F.count(text), "valid": valid.cast("double"), "digits": mixed,
                "constant": (F.min(text) == F.max(text)).cast("int")}

    s = per_column(df, df.columns, make)
    share = F.col("digits") / F.col("filled")
    totals = s.agg(
        F.avg(F.try_divide(F.col("rows") - F.col("filled"), F.col("rows"))).alias("missing"),
        F.count_if((share > 0.3) & (share < 0.7)).alias("mixed"), F.avg("valid").alias("valid"),
        F.coalesce(F.sum("constant"), F.lit(0)).alias("constants"),
        F.count_if(F.try_divide(F.col("filled"), F.col("rows")) < 0.5).alias("sparse"))
    copies = duplicate_report(df).select((F.col("duplicate_rows") / F.greatest("rows", F.lit(1))).alias("dup"))
    both = totals.withColumn("_k", F.lit(1)).join(copies.withColumn("_k", F.lit(1)), "_k")
    base = 100 - F.col("missing") * 30 - F.col("dup") * 20

    def bounded(c):
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))

    variety = sum(1 for c in df.columns if is_string(df, c) or is_numeric(df, c)) / len(df.columns) * 5
    weighted = (base - F.least(F.col("mixed") * 3, F.lit(15)) - (1 - F.coalesce("valid", F.lit(0.8))) * 15
                - F.least(F.col("sparse") * 2, F.lit(10)) - F.least(F.col("constants") * 2, F.lit(5)) + variety)
    return both.select(bounded(base - issue_count * 2).alias("simple"), bounded(weighted).alias("weighted"))


def recommend_fixes(issues: DataFrame) -> DataFrame:
    """``(action, column, priority, confidence, params)``: one suggestion per action and column."""
    config = issues.sparkSession.createDataFrame(
        [(k, *v) for k, v in RECOMMENDED.items()],
        "type string, priority string, action string, params string, confidence double")
    rank = F.create_map(*[F.lit(x) for k in (("high", 0), ("medium", 1), ("low", 2)) for x in k])
    joined = issues.join(F.broadcast(config), "type")
    best = F.min_by(F.struct("priority", "params", "confidence"), F.struct(rank[F.col("severity")].alias("r"), F.col("type").alias("t")))
    return joined.groupBy("action", "column").agg(best.alias("b")).select("action", "column", "b.*")


def find_dirty_patterns(df: DataFrame) -> DataFrame:
    """Shares of dirty patterns per text column, plus negatives in numeric ones."""
    tokens = [t.lower() for t in fixed.DIRTY_NULL_TOKENS]

    def make(name):
        c, text = col(name), col(name).cast("string")
        if is_numeric(df, name):
            zero = F.lit(None).cast("double")
            return {k: zero + F.count_if(F.lit(False)) for k in
                    ("dirty_null", "currency", "comma_number", "phone_noise", "upper_case", "lower_case", "numeric_text")} | {
                "negative": F.avg((c < 0).cast("double"))}

        def share(test):
            return F.avg(test.cast("double"))

        letters = text.rlike("[A-Za-z]")
        return {
            "dirty_null": share(F.lower(text).isin(tokens)), "currency": share(text.rlike("[$€£¥₹]")),
            "comma_number": share(text.rlike(r"^\s*-?\d{1,3}(,\d{3})+(\.\d+)?\s*$")),
            "phone_noise": share(text.rlike(r"^[+(]?\d[\d\s().-]{6,}$")),
            "upper_case": share(letters & (text == F.upper(text))), "lower_case": share(letters & (text == F.lower(text))),
            "numeric_text": share(to_number(text).isNotNull()), "negative": share(to_number(text) < 0),
        }

    return per_column(df, df.columns, make)
