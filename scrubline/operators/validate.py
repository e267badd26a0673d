"""Validation flags, rule sets and named patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import action, as_list, batches, col, is_numeric, is_temporal, string_columns
from ..functions import values as fixed
from ..functions.dates import as_timestamp, parse_dates
from ..functions.numbers import to_number
from ..functions.text import strip


def _flag(df: DataFrame, name: str, flag_col: str | None, suffix: str, bad: Column) -> DataFrame:
    """Boolean flag; a null value counts as bad."""
    return df.withColumn(flag_col or name + suffix, F.coalesce(bad, F.lit(True)))


@action("validate_regex", row_wise=True)
def validate_regex(df: DataFrame, column: str, pattern: str, flag_col: str | None = None,
                   invert: bool = False) -> DataFrame:
    hit = col(column).cast("string").rlike(pattern)
    return _flag(df, column, flag_col, "_invalid_format", hit if invert else ~hit)


@action("validate_range", row_wise=True)
def validate_range(df: DataFrame, column: str, min_val=None, max_val=None,
                   flag_col: str | None = None) -> DataFrame:
    number = to_number(col(column), is_numeric(df, column))
    inside = number.isNotNull()
    if min_val is not None:
        inside = inside & (number >= min_val)
    if max_val is not None:
        inside = inside & (number <= max_val)
    return _flag(df, column, flag_col, "_out_of_range", ~inside)


@action("validate_format", row_wise=True)
def validate_format(df: DataFrame, column: str, format: str, flag_col: str | None = None) -> DataFrame:
    text = col(column).cast("string")
    kind = format.lower()
    if kind == "date":
        good = parse_dates(text, False).isNotNull()
    elif kind in fixed.FORMAT_PATTERNS:
        if kind == "credit_card":
            text = F.translate(text, " -", "")
        good = text.rlike(fixed.FORMAT_PATTERNS[kind])
    else:
        raise ValueError(f"unknown format: {format}")
    return _flag(df, column, flag_col, "_invalid_format", ~good)


@action("flag_invalid_emails", row_wise=True)
def flag_invalid_emails(df: DataFrame, column: str, flag_col: str | None = None) -> DataFrame:
    return _flag(df, column, flag_col, "_invalid", ~strip(col(column).cast("string")).rlike(fixed.EMAIL_PATTERN))


def _valid(df: DataFrame, column: str, pattern: str, flag_col: str) -> DataFrame:
    """Boolean flag that is true for good values; null is not good."""
    hit = col(column).cast("string").rlike(pattern)
    return df.withColumn(flag_col, F.coalesce(hit, F.lit(False)))


@action("validate_email_advanced", row_wise=True)
def validate_email_advanced(df: DataFrame, column: str, flag_col: str | None = None) -> DataFrame:
    return _valid(df, column, fixed.EMAIL_ADVANCED_PATTERN, flag_col or f"{column}_email_valid")


@action("validate_phone", row_wise=True)
def validate_phone(df: DataFrame, column: str, country: str = "US", flag_col: str | None = None) -> DataFrame:
    pattern = fixed.PHONE_PATTERNS.get(country, fixed.PHONE_PATTERNS["INTL"])
    return _valid(df, column, pattern, flag_col or f"{column}_phone_valid")


@action("validate_postal_code", row_wise=True)
def validate_postal_code(df: DataFrame, column: str, country: str = "US", flag_col: str | None = None) -> DataFrame:
    pattern = "(?i)" + fixed.POSTAL_PATTERNS.get(country, fixed.POSTAL_DEFAULT_PATTERN)
    return _valid(df, column, pattern, flag_col or f"{column}_postal_valid")


# ------------------------------------------------------------------ rule sets

_COMPARE = {
    "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b,
}


def violation(df: DataFrame, rule: dict) -> Column | None:
    """Boolean column: true where a row breaks the rule (None for unknown rules)."""
    kind, name = rule.get("type"), rule.get("column")
    if kind == "cross_column":
        a, b = rule.get("col_a"), rule.get("col_b")
        if a not in df.columns or b not in df.columns:
            return None
        if is_temporal(df, a) or is_temporal(df, b):
            left, right = as_timestamp(df, a, False), as_timestamp(df, b, False)
        else:
            left, right = (to_number(col(c), is_numeric(df, c)) for c in (a, b))
        holds = _COMPARE[rule.get("op", "lt")](left, right)
        return F.when(left.isNull() | right.isNull(), F.lit(rule.get("op") == "eq")).otherwise(~holds)
    if kind in ("lambda", "predicate"):
        return ~F.coalesce(F.expr(rule["expression"]), F.lit(False))
    if name not in df.columns:
        return None
    text = F.coalesce(col(name).cast("string"), F.lit(""))
    number = to_number(col(name), is_numeric(df, name))
    if kind == "not_null":
        return col(name).isNull() | (strip(text) == "")
    if kind == "positive":
        return ~F.coalesce(number > 0, F.lit(False))
    if kind == "range":
        tests = [number.isNull()]
        if rule.get("min") is not None:
            tests.append(number < rule["min"])
        if rule.get("max") is not None:
            tests.append(number > rule["max"])
        return F.coalesce(reduce(lambda x, y: x | y, tests), F.lit(True))
    if kind == "enum":
        return ~F.lower(strip(text)).isin([str(v).strip().lower() for v in rule.get("values", [])])
    if kind == "regex":
        return ~text.rlike(rule.get("pattern", ""))
    if kind == "max_length":
        return F.length(text) > rule.get("max", 255)
    if kind == "not_equal":
        value = rule.get("value")
        return text == ("" if value is None else str(value))
    if kind == "contains":
        return ~F.lower(text).contains(str(rule.get("value", "")).lower())
    if kind == "starts_with":
        return ~text.startswith(str(rule.get("value", "")))
    if kind == "pattern" and rule.get("pattern_name") in fixed.PATTERNS:
        return ~text.rlike(fixed.PATTERNS[rule["pattern_name"]])
    return None


def rule_name(rule: dict) -> str:
    parts = [rule.get("type", "")] + [
        str(rule[k]) for k in ("column", "col_a", "op", "col_b") if rule.get(k) is not None
    ]
    return ":".join(parts)


def run_validation(df: DataFrame, rules: list[dict]) -> DataFrame:
    """``(rule_id, rule, violations, violation_pct, passed, note)``, one row per rule.

    All row rules are counted in one aggregate.  A ``unique`` rule counts rows
    minus distinct values, so a hot value is pre-summed before the shuffle.
    """
    masks, notes, uniques = {}, {}, {}
    for i, rule in enumerate(rules):
        if rule.get("type") == "unique" and rule.get("column") in df.columns:
            uniques[i] = rule["column"]
            continue
        mask = violation(df, rule)
        if mask is None:
            notes[i] = "skipped: unknown rule or missing column"
        else:
            masks[i] = mask
    items = list(masks.items())
    parts: list[DataFrame] = []

    def rows(source: DataFrame, counted: dict[int, Column], note: str | None = None) -> DataFrame:
        structs = F.array(*[
            F.struct(F.lit(i).alias("rule_id"), F.lit(rule_name(rules[i])).alias("rule"),
                     F.coalesce(c, F.lit(0)).cast("long").alias("violations"),
                     F.lit(notes.get(i)).cast("string").alias("note"), F.col("_rows"))
            for i, c in counted.items()
        ])
        return source.select(F.inline(structs))

    for chunk in batches(items, 40):
        counted = df.agg(F.count("*").alias("_rows"), *[F.count_if(m).alias(f"c{i}") for i, m in chunk])
        parts.append(rows(counted, {i: F.col(f"c{i}") for i, _m in chunk}))
    for i, name in uniques.items():
        per_value = df.groupBy(col(name)).agg(F.count("*").alias("_c"))
        repeats = per_value.agg(F.sum("_c").alias("_rows"), F.sum(F.col("_c") - 1).alias("_d"))
        parts.append(rows(repeats, {i: F.col("_d")}))
    if notes:
        parts.append(rows(df.agg(F.count("*").alias("_rows")), {i: F.lit(0) for i in notes}))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    share = F.round(F.col("violations") / F.greatest(F.col("_rows"), F.lit(1)) * 100, 2)
    return out.select("rule_id", "rule", "violations", share.alias("violation_pct"),
                      (F.col("violations") == 0).alias("passed"), "note")


def violation_samples(df: DataFrame, rule: dict, n: int = 5) -> DataFrame:
    """A few rows that break a rule (``unique``: rows of repeated values)."""
    if rule.get("type") == "unique":
        repeated = df.groupBy(col(rule["column"]).alias("_v")).count().where("count > 1")
        return df.join(repeated, col(rule["column"]).eqNullSafe(F.col("_v")), "left_semi").limit(n)
    mask = violation(df, rule)
    return df.where(mask).limit(n) if mask is not None else df.limit(0)


# -------------------------------------------------------------- named patterns

def pattern_hit(text: Column, name: str) -> Column:
    """Match test; a literal that every match contains is looked for first, which is far cheaper."""
    test = text.rlike(fixed.PATTERNS[name])
    literal = fixed.PATTERN_LITERALS.get(name)
    return F.contains(text, F.lit(literal)) & test if literal else test


def pattern_validate(df: DataFrame, columns=None, patterns=None) -> DataFrame:
    """``(column, pattern_name, category, matches, total, match_pct)`` for all pairs."""
    names = as_list(columns) or string_columns(df)
    wanted = as_list(patterns) or list(fixed.PATTERNS)
    unknown = [p for p in wanted if p not in fixed.PATTERNS]
    if unknown:
        raise ValueError(f"unknown patterns: {unknown}")
    # one scan for all columns, and a row for each column even without rows
    texts = df.select(*[col(c).cast("string").alias(c) for c in names]).unpivot([], names, "column", "text")
    counted = texts.groupBy("column").agg(F.count("text").alias("total"), *[F.count_if(pattern_hit(F.col("text"), p)).alias(p) for p in wanted])
    counted = df.sparkSession.createDataFrame([(c,) for c in names], "column string").join(counted, "column", "left")
    items = F.array(*[
        F.struct(F.lit(p).alias("pattern_name"), F.lit(fixed.PATTERN_CATEGORY[p]).alias("category"), F.coalesce(col(p), F.lit(0)).alias("matches"))
        for p in wanted
    ])
    out = counted.select("column", F.coalesce("total", F.lit(0)).alias("total"), F.inline(items)).select("column", "pattern_name", "category", "matches", "total")
    return out.withColumn("match_pct", F.round(F.try_divide("matches", "total") * 100, 2))


def pattern_samples(df: DataFrame, column: str, pattern_name: str, n: int = 10, matching: bool = True) -> DataFrame:
    hit = col(column).cast("string").rlike(fixed.PATTERNS[pattern_name])
    return df.where(hit if matching else ~hit).select(col(column)).limit(n)


@action("pattern_extract", row_wise=True)
def pattern_extract(df: DataFrame, column: str, pattern_name: str, new_col: str | None = None) -> DataFrame:
    """First match of a named pattern, null without a match."""
    if pattern_name not in fixed.PATTERNS:
        raise ValueError(f"unknown pattern: {pattern_name}")
    found = F.regexp_substr(col(column).cast("string"), F.lit(fixed.PATTERNS[pattern_name]))
    return df.withColumn(new_col or f"{column}_{pattern_name}", found)


def list_patterns(spark) -> DataFrame:
    rows = [(n, fixed.PATTERN_CATEGORY[n], p) for n, p in fixed.PATTERNS.items()]
    return spark.createDataFrame(rows, "name string, category string, pattern string")
