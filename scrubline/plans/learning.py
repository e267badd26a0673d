"""Rules mined from many datasets: features, rules, outcomes, report analytics.

A collection is one long table ``(dataset, column, value)``; all statistics are
grouped aggregates over it, with values counted before they meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import col
from ..functions import values as fixed

# --- fixed values ------------------------------------------------------------
COLUMN_PATTERNS = {
    "email": r"email", "phone": r"phone|tel|mobile", "name": r"name|first|last|full", "address": r"address|street",
    "city": r"city", "state": r"state", "zip": r"zip|postal|pin", "date": r"date|time|dob|born", "price": r"price|cost|amount",
    "id": r"id|code|number", "status": r"status|state|flag", "gender": r"gender|sex", "url": r"url|link|website",
}
# rule type -> (words in the column name, action, confidence)
NAME_RULES = [
    ("currency", "price|cost|amount", "parse_currency", 0.7), ("email", "email|mail", "flag_invalid_emails", 0.95),
    ("phone", "phone|tel|mobile|cell", "normalize_phone", 0.9), ("numeric", "salary|balance|revenue|income|expense", "coerce_numeric", 0.85),
    ("date", "date|created|updated|dob", "standardise_dates", 0.9),
]
VALUE_RULES = [
    (r"^\d{4}-\d{2}-\d{2}", "standardise_dates"), (r"^\d{2}/\d{2}/\d{4}", "standardise_dates"), (r"^\$[\d,]+\.?\d*", "parse_currency"),
    (r"^€[\d,]+\.?\d*", "parse_currency"), (r"^₹[\d,]+\.?\d*", "parse_currency"), (r"^\d+%$", "parse_percentage"), (r"^[\d,]+\.?\d*$", "parse_number_formatted"),
]
DOMAIN_RULES = [
    ("hr", "clip_outliers"), ("hr", "normalise_categories"), ("sales", "parse_currency"), ("sales", "standardise_dates"),
    ("customer", "flag_invalid_emails"), ("customer", "normalize_phone"), ("ecommerce", "parse_currency"), ("ecommerce", "validate_range"),
]
# --- end of fixed values -----------------------------------------------------


def long_table(tables: dict[str, DataFrame]) -> DataFrame:
    """``(dataset, column, value)`` of every cell as text."""
    parts = [
        t.select(*[col(c).cast("string").alias(c) for c in t.columns]).unpivot([], t.columns, "column", "value")
        .select(F.lit(name).alias("dataset"), "column", "value")
        for name, t in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def extract_dataset_features(cells: DataFrame, top: int = 3) -> DataFrame:
    """One row per (dataset, column): null share, distinct values, cardinality, currency, id, errors, prefixes."""
    # values are counted first: everything below works on distinct values with weights
    counts = cells.groupBy("dataset", "column", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n")

    def weight(test):
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    digits = v.rlike(r"^-?\d+\.?\d*$")
    stats = counts.groupBy("dataset", "column").agg(
        F.sum(n).alias("rows"), weight(v.isNull()).alias("nulls"), F.count(v).alias("unique_count"),
        weight(v.rlike("[$€£¥₹₽₿]")).alias("currency_hits"), weight(digits).alias("numeric_hits"),
        weight(F.lower(F.trim(v)).isin(fixed.ERROR_PLACEHOLDERS)).alias("error_hits"),
        F.min(v).alias("sample_value"),
        *[weight(v.rlike(p)).alias(f"v{i}") for i, (p, _a) in enumerate(VALUE_RULES)])
    parts = F.split(v, r"[\s_\-]+")
    heads = counts.where(v.isNotNull() & (F.size(parts) > 1)).groupBy("dataset", "column", parts[0].alias("prefix")).agg(F.sum(n).alias("c"))
    totals = heads.groupBy("dataset", "column").agg(F.sum("c").alias("all"))
    # a prefix above a tenth of the total: at most nine per column
    common = heads.join(totals, ["dataset", "column"]).where("c > all * 0.1").groupBy("dataset", "column").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), "prefix"))), 1, top).alias("p"))
    prefixes = common.select("dataset", "column", F.array_join(F.transform("p", lambda x: x["prefix"]), ",").alias("common_prefixes"))
    filled = F.col("rows") - F.col("nulls")
    return stats.join(prefixes, ["dataset", "column"], "left").select(
        "dataset", "column", "rows", (F.col("nulls") / F.col("rows")).alias("null_share"), "unique_count",
        F.when(F.col("unique_count") <= 10, "low").when(F.col("unique_count") <= 100, "medium").otherwise("high").alias("cardinality"),
        (F.col("currency_hits") > 0).alias("is_currency"), (F.try_divide("numeric_hits", filled) > 0.8).alias("is_numeric"),
        F.lower("column").rlike(r"(^id$|_id$|key$|^uuid|^guid)").alias("is_id"), (F.col("error_hits") > 0).alias("has_errors"),
        F.coalesce("common_prefixes", F.lit("")).alias("common_prefixes"),
        *[(F.try_divide(f"v{i}", filled) > 0.5).alias(f"v{i}") for i in range(len(VALUE_RULES))])


def mine_rules(features: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """``(trigger, pattern, action, confidence, support)``; support = number of (dataset, column) hits.

    Rule templates are literals, so the feature table is read once and nothing is joined.
    """
    found = []
    for i, (kind, words, act, confidence) in enumerate(NAME_RULES):
        sure = F.when(F.col("is_currency"), 0.9).otherwise(confidence) if kind == "currency" else F.lit(confidence)
        found.append(F.when(F.lower("column").rlike(words), F.struct(
            F.lit("column_name").alias("trigger"), F.lit(words).alias("pattern"), F.lit(act).alias("action"), sure.cast("double").alias("confidence"))))
    low = (F.col("cardinality") == "low") & ~F.coalesce("is_numeric", F.lit(False))
    found.append(F.when(low, F.struct(F.lit("cardinality").alias("trigger"), F.lit("low").alias("pattern"), F.lit("normalise_categories").alias("action"), F.lit(0.8).alias("confidence"))))
    for i, (pattern, act) in enumerate(VALUE_RULES):
        found.append(F.when(F.col(f"v{i}"), F.struct(F.lit("value_pattern").alias("trigger"), F.lit(pattern).alias("pattern"), F.lit(act).alias("action"), F.lit(0.85).alias("confidence"))))
    found.append(F.when(F.col("has_errors"), F.struct(F.lit("error_values").alias("trigger"), F.lit("placeholder").alias("pattern"), F.lit("replace_error_placeholders").alias("action"), F.lit(0.95).alias("confidence"))))
    hits = features.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")).select("r.*")
    if domains is not None:
        table = features.sparkSession.createDataFrame(DOMAIN_RULES, "domain string, action string")
        hits = hits.unionByName(domains.join(F.broadcast(table), "domain").select(
            F.lit("domain").alias("trigger"), F.col("domain").alias("pattern"), "action", F.lit(0.8).alias("confidence")))
    return hits.groupBy("trigger", "pattern", "action").agg(F.max("confidence").alias("confidence"), F.count("*").alias("support"))


def match_rules(rules: DataFrame, features: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """``(dataset, column, action, confidence, support)`` of the rules that fit a column.

    The mined rules are a short list (one row per template at most), collected
    under a hard limit and tried as literals, so no pair table arises.
    """
    limit = 1000
    listed = rules.limit(limit + 1).collect()
    if len(listed) > limit:
        raise ValueError(f"more than {limit} rules; filter them by confidence or support first")
    tests = []
    for r in listed:
        if r.trigger == "column_name":
            test = F.lower("column").rlike(r.pattern)
        elif r.trigger == "cardinality":
            test = (F.col("cardinality") == r.pattern) & ~F.coalesce("is_numeric", F.lit(False))
        elif r.trigger == "error_values":
            test = F.col("has_errors")
        elif r.trigger == "value_pattern":
            test = F.col(f"v{[p for p, _a in VALUE_RULES].index(r.pattern)}")
        else:
            continue
        tests.append(F.when(test, F.struct(F.lit(r.action).alias("action"), F.lit(r.confidence).alias("confidence"), F.lit(r.support).alias("support"))))
    if not tests:
        return features.select("dataset", "column", F.lit("").alias("action"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("support")).limit(0)
    fitting = features.select("dataset", "column", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("r")).select("dataset", "column", "r.*")
    return fitting.groupBy("dataset", "column", "action").agg(F.max("confidence").alias("confidence"), F.max("support").alias("support"))


def _column_pattern(c):
    chain = None
    for name, regex in COLUMN_PATTERNS.items():
        test = F.lower(c).rlike(regex)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise("other")


def learn_rules(steps: DataFrame) -> DataFrame:
    """Cleaning steps ``(domain, action, column, cells_affected)`` -> rules with a confidence.

    Confidence grows with the number of uses and with the success of the first one.
    """
    used = steps.where("action <> '' and column <> ''")
    key = F.concat(F.col("action"), F.lit(":"), F.regexp_replace(F.lower("column"), "[^a-z0-9]", "_"))
    rules = used.groupBy(key.alias("pattern"), "action", _column_pattern(F.col("column")).alias("column_pattern")).agg(
        F.count("*").alias("times_applied"), F.min("domain").alias("domain"),
        F.avg((F.col("cells_affected") > 0).cast("double")).alias("hit_share"))
    times = F.col("times_applied")
    rate = F.when(F.col("hit_share") > 0, 0.8).otherwise(0.5)
    base = F.when(times >= 10, F.least(F.lit(0.95), 0.5 + times * 0.02)).when(times >= 5, F.least(F.lit(0.85), 0.4 + times * 0.04)).otherwise(0.5)
    return rules.select("pattern", "action", "column_pattern", "domain", "times_applied", rate.alias("success_rate"), base.alias("confidence"))


def suggest_rules(rules: DataFrame, columns: DataFrame) -> DataFrame:
    """Best rule per column ``(dataset, column)`` through its name pattern."""
    best = rules.groupBy("column_pattern").agg(
        F.max_by(F.struct("action", "confidence", "times_applied"), F.struct("confidence", "times_applied", "action")).alias("b"))
    return columns.withColumn("column_pattern", _column_pattern(F.col("column"))).join(best, "column_pattern").select(
        "dataset", "column", F.col("b.action").alias("suggested_action"), F.col("b.confidence").alias("confidence"), F.col("b.times_applied").alias("based_on"))


def rule_outcomes(results: DataFrame) -> DataFrame:
    """``(rule, succeeded)`` results -> success rate and advice for rules used five times and more."""
    rates = results.groupBy("rule").agg(F.count("*").alias("uses"), F.avg(F.col("succeeded").cast("double")).alias("success_rate")).where("uses >= 5")
    advice = F.when(F.col("success_rate") < 0.7, "disable").when(F.col("success_rate") > 0.95, "auto_apply").otherwise("keep")
    return rates.withColumn("suggestion", advice)


def report_analytics(reports: DataFrame) -> DataFrame:
    """``(topic, key, count)`` from nested cleaning reports.

    ``reports``: dataset, domain, initial_score, final_score, issues
    array<struct<issue_type, column>>, steps array<struct<action, column>>,
    null_counts map<string, long>.
    """
    def counted(topic, frame, key):
        return frame.groupBy(key.alias("key")).agg(F.count("*").cast("double").alias("count")).select(F.lit(topic).alias("topic"), "key", "count")

    issues = reports.select(F.explode("issues").alias("i"))
    steps = reports.select("domain", F.explode("steps").alias("s"))
    nulls = reports.select(F.explode("null_counts").alias("column", "n")).where("n > 0")
    scores = reports.agg(F.avg("initial_score").alias("initial"), F.avg("final_score").alias("final"), F.count_if(F.col("final_score") < 70).cast("double").alias("low"))
    quality = scores.select(F.inline(F.array(*[
        F.struct(F.lit("quality").alias("topic"), F.lit(k).alias("key"), F.col(k).alias("count")) for k in ("initial", "final", "low")])))
    return reduce(lambda a, b: a.unionByName(b), [
        counted("domain", reports, F.col("domain")), counted("issue", issues, F.col("i.issue_type")), counted("issue_column", issues, F.col("i.column")),
        counted("action", steps, F.col("s.action")), counted("action_by_domain", steps, F.concat_ws(":", "domain", F.col("s.action"))),
        counted("null_column", nulls, F.col("column")), quality])
