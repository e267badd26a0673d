"""Cleaning programs: operators chained by default, by column, by domain, or by profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ACTIONS, batches, col, numeric_columns, string_columns, with_exprs
from ..functions import text as tx
from ..functions import values as fixed
from ..functions.dates import date_like
from ..functions.numbers import clamp, strip_to_number
from ..operators import dates as date_ops
from ..operators import dedup, missing, rows, schema
from ..operators import text as text_ops
from ..operators.fields import domain_clean
from ..operators.issues import quality_score
from ..operators.profile import domain_of, per_column
from .isolation import run_isolated
from .pipeline import apply_transformation
from .strategies import domain_steps


def auto_clean(df: DataFrame) -> DataFrame:
    """Duplicates, dirty nulls, white space, title case, categories."""
    return (
        df.transform(dedup.remove_duplicates).transform(text_ops.convert_dirty_nulls)
        .transform(text_ops.trim_whitespace).transform(text_ops.standardise_capitalisation)
        .transform(text_ops.normalise_categories)
    )


def auto_clean_explained(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned, report ``(step, action, rows_before, rows_after, cells_changed, columns)``).

    The three text steps are counted in one pass over before/after pairs.
    """
    unique = dedup.remove_duplicates(df)
    names = string_columns(df)
    trimmed = {c: tx.squeeze(col(c)) for c in names}
    titled = {c: tx.title(tx.squeeze(col(c))) for c in names}
    ready = with_exprs(unique, titled)
    final = text_ops.normalise_categories(ready)

    def changed(pairs):
        return [F.count_if(~a.eqNullSafe(b)) for a, b in pairs]

    counts = unique.agg(
        F.count("*").alias("after"),
        *[e.alias(f"t{i}") for i, e in enumerate(changed([(col(c), trimmed[c]) for c in names]))],
        *[e.alias(f"c{i}") for i, e in enumerate(changed([(trimmed[c], titled[c]) for c in names]))])
    mapped = _category_changes(ready, final, names)
    before = df.agg(F.count("*").alias("before")).withColumn("_k", F.lit(1))
    joined = counts.withColumn("_k", F.lit(1)).join(before, "_k").join(mapped.withColumn("_k", F.lit(1)), "_k")

    def line(step, action, start, end, cells, touched):
        return F.struct(F.lit(step).alias("step"), F.lit(action).alias("action"), F.col(start).alias("rows_before"), F.col(end).alias("rows_after"),
                        cells.cast("long").alias("cells_changed"), touched.cast("array<string>").alias("columns"))

    def total(prefix):
        return sum((F.col(f"{prefix}{i}") for i in range(len(names))), F.lit(0))

    def touched(prefix):
        return F.filter(F.array(*[F.when(F.col(f"{prefix}{i}") > 0, F.lit(c)) for i, c in enumerate(names)]), lambda x: x.isNotNull())

    report = joined.select(F.inline(F.array(
        line(1, "remove_duplicates", "before", "after", F.lit(0), F.array()),
        line(2, "trim_whitespace", "after", "after", total("t"), touched("t")),
        line(3, "standardise_capitalisation", "after", "after", total("c"), touched("c")),
        line(4, "normalise_categories", "after", "after", total("m"), touched("m")))))
    return final, report


def _category_changes(ready: DataFrame, final: DataFrame, names: list[str]) -> DataFrame:
    """Cells per column that the category step changes: it maps spellings, so value counts tell."""
    out = None
    for i, c in enumerate(names):
        def counts(d, sign):
            return d.where(col(c).isNotNull()).groupBy(col(c).alias("v")).agg((F.count("*") * sign).alias("n"))

        moved = counts(ready, 1).unionByName(counts(final, -1)).groupBy("v").agg(F.sum("n").alias("d")).agg(
            F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias(f"m{i}"))
        moved = moved.withColumn("_j", F.lit(1))
        out = moved if out is None else out.join(moved, "_j")
    return out.drop("_j")


# --- fixed values: words in a column name -> kind of cleaner --------------------
COLUMN_WORDS = [
    ("email", ["email"]), ("phone", ["phone", "tel", "mobile", "fax"]), ("gender", ["gender"]), ("status", ["status"]),
    ("address", ["address", "street"]), ("city", ["city"]), ("state", ["state"]), ("zipcode", ["zip", "postal"]),
    ("url", ["url", "link", "website"]), ("sku", ["sku", "product_code"]),
]
STATUS_WORDS = [
    ("Inactive", ["inactive", "closed", "past", "no", "0", "false", "terminated"]),
    ("Active", ["active", "open", "current", "yes", "1", "true"]), ("Pending", ["pending", "waiting", "processing"]),
]
GENDER_WORDS = [("Female", ["female", "woman", "girl", "f"]), ("Male", ["male", "man", "boy", "m"])]
BOOLEAN_HINTS = ["true", "false", "yes", "no", "1", "0"]
# --- end of fixed values ---------------------------------------------------------


def _words(c, table, rest):
    """Label of the first row with one of its whole words in the text."""
    low = F.lower(tx.strip(c))
    chain = None
    for label, words in table:
        test = low.rlike(r"(?<![a-z0-9])(" + "|".join(words) + r")(?![a-z0-9])")
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(rest(low))


def _phone(c):
    d = F.regexp_replace(c, r"\D", "")
    return (
        F.when(F.length(d) == 10, F.regexp_replace(d, r"(\d{3})(\d{3})(\d{4})", r"($1) $2-$3"))
        .when((F.length(d) == 11) & d.startswith("1"), F.regexp_replace(d, r"1(\d{3})(\d{3})(\d{4})", r"+1 ($1) $2-$3"))
        .otherwise(tx.strip(c))
    )


def _address(c):
    text = tx.strip(c)
    for pattern, short in fixed.STREET_TYPES.items():
        text = F.regexp_replace(text, "(?i)" + pattern, short)
    return tx.title(text)


def _state(c):
    s = tx.strip(c)
    codes = [k for k in fixed.US_STATES if k != "dc"]
    return F.when(F.lower(s).isin(codes) | s.rlike("^[A-Z]{2}$"), F.upper(s)).otherwise(tx.title(s))


def _zip(c):
    d = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(d).isin(5, 9), F.left(d, F.lit(5))).when(F.length(d) == 4, F.concat(F.lit("0"), d)).otherwise(tx.strip(c))


def _url(c):
    s = tx.strip(c)
    return F.lower(F.when(s.rlike(r"^(https?://|www\.)"), s).otherwise(F.concat(F.lit("https://"), s)))


CLEANERS = {
    "email": lambda c: F.lower(tx.strip(c)), "phone": _phone,
    "gender": lambda c: _words(c, GENDER_WORDS, lambda low: F.lit("Other")),
    "status": lambda c: _words(c, STATUS_WORDS, tx.title), "address": _address,
    "city": lambda c: tx.title(F.regexp_replace(tx.strip(c), r"[^a-zA-Z\s\-]", "")), "state": _state, "zipcode": _zip, "url": _url,
    "sku": lambda c: F.regexp_replace(F.upper(tx.strip(c)), r"[^A-Z0-9\-_]", ""),
    "boolean": lambda c: F.when(tx.clean_key(c).isin(fixed.BOOLEAN_TRUE), True).when(tx.clean_key(c).isin(fixed.BOOLEAN_FALSE), False),
    "percentage": lambda c: strip_to_number(c, "[%, ]"),
}


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Cleaner of each text column: by name, else two boolean-like values, else a percent share."""
    kinds, open_columns = {}, []
    for name in string_columns(df):
        kind = next((k for k, words in COLUMN_WORDS if any(w in name.lower() for w in words)), None)
        if kind:
            kinds[name] = kind
        else:
            open_columns.append(name)
    if open_columns:
        def make(name):
            key = F.lower(col(name))
            return {"n": F.count(key), "low": F.min(key), "high": F.max(key), "hints": F.count_if(key.isin(BOOLEAN_HINTS)),
                    "percent": F.count_if(F.contains(key, F.lit("%")))}

        stats = {r["column"]: r for r in per_column(df, open_columns, make).collect()}
        for name in open_columns:
            s = stats[name]
            if s["n"] and s["hints"] and s["low"] != s["high"]:
                others = df.where(col(name).isNotNull() & ~F.lower(col(name)).isin(s["low"], s["high"])).limit(1)
                if others.isEmpty():
                    kinds[name] = "boolean"
            if name not in kinds and s["n"] and s["percent"] / s["n"] > 0.3:
                kinds[name] = "percentage"
    return kinds


def auto_clean_columns(df: DataFrame) -> DataFrame:
    """Pick a cleaner per text column and apply all in one projection; blank text becomes null."""
    exprs = {}
    for name, kind in column_kinds(df).items():
        exprs[name] = F.when(tx.strip(col(name)) != "", CLEANERS[kind](col(name)))
    return with_exprs(df, exprs)


# --- fixed value: what stands before an amount of money --------------------------
CURRENCY_MARK = r"[$€£¥₹₽]"
# --- end of fixed values -----------------------------------------------------------------


def plan_smart_clean(df: DataFrame, intensity: str = "standard") -> list[dict]:
    """Steps for a table from ONE profiling aggregate and its column names."""
    domain, confidence = domain_of(df)
    texts = string_columns(df)
    steps = [{"action": "remove_duplicates", "params": {}}]
    found = {"currency": [], "numbers": [], "dates": []}
    if texts:
        def make(name):
            c = col(name)
            return {"n": F.count(c), "currency": F.count_if(c.rlike(CURRENCY_MARK + r"\s*-?\d")),
                    "commas": F.count_if(c.rlike(r"^\s*-?\d{1,3}(,\d{3})+(\.\d+)?\s*$|^\s*-?\d{1,3}(\.\d{3})+,\d+\s*$")),
                    "dates": F.count_if(date_like(c) & ~c.rlike(r"^\d{4}-\d{2}-\d{2}$")), "all_dates": F.count_if(date_like(c))}

        stats = per_column(df, texts, make).collect()
        for s in stats:
            n, name = s["n"], s["column"]
            if not n:
                continue
            if s["currency"] > 0.5 * n:
                found["currency"].append(name)
                steps.append({"action": "parse_currency", "params": {"column": name, "new_col": name}})
            elif s["commas"] > 0.5 * n:
                found["numbers"].append(name)
                steps.append({"action": "parse_number_formatted", "params": {"column": name, "new_col": name}})
            elif s["all_dates"] > 0.8 * n and s["dates"]:
                found["dates"].append(name)
                steps.append({"action": "standardise_mixed_dates", "params": {"column": name}})
    numbers = {s["params"].get("column") for s in steps} - {None}
    plain = [t for t in texts if t not in numbers]
    if plain:
        steps += [{"action": "replace_error_placeholders", "params": {"columns": plain}},
                  {"action": "trim_whitespace", "params": {"columns": plain}}]
        if intensity != "gentle":
            named = [t for t in plain if not any(w in t.lower() for w in ("email", "url", "id", "code"))]
            steps += [{"action": "standardise_capitalisation", "params": {"columns": named}},
                      {"action": "normalise_categories", "params": {"columns": named}}] if named else []
    # what the profile has planned already is not planned again
    steps += [s for s in domain_steps(df.columns, texts, domain, found) if s not in steps]
    if intensity != "gentle":
        steps.append({"action": "impute_auto", "params": {}})
    if intensity == "aggressive":
        steps += [{"action": "clip_outliers", "params": {"column": c, "iqr_factor": 3.0}} for c in numeric_columns(df)]
    return [s | {"domain": domain, "confidence": confidence} for s in steps]


def smart_auto_clean(df: DataFrame, intensity: str = "standard", dry_run: bool = False) -> dict:
    """Plan from a profile, apply, and score before and after.

    ``df`` stays the input on a dry run; ``quality`` is a lazy two-row table.  A
    step that doesn't fit, or fails on the data, is reported in ``errors`` and left out;
    ``applied`` tells rows and changed columns of the others.
    """
    steps = plan_smart_clean(df, intensity)
    run = run_isolated(df, [] if dry_run else steps, dry_run=dry_run)
    current, errors = run["df"], run["errors"]
    done = [steps[r["index"]] | {k: r[k] for k in ("rows_before", "rows_after", "columns_changed")} for r in run["steps_run"]]
    before = quality_score(df).withColumn("stage", F.lit("before"))
    quality = before.unionByName(quality_score(current).withColumn("stage", F.lit("after")))
    return {"df": current, "planned": steps, "applied": done, "errors": errors, "quality": quality}


def cap_outliers(df: DataFrame, iqr_factor: float = 3.0) -> DataFrame:
    """Limit all numeric columns to their fences with one quantile pass."""
    names = numeric_columns(df)
    limits = rows.fences(df, names, "iqr", iqr_factor) if names else {}
    return with_exprs(df, {c: clamp(col(c), *f) for c, f in limits.items() if f[0] < f[1]})


def deep_clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned table, scores before and after): the full fourteen-step program."""
    domain, _confidence = domain_of(df)
    current = dedup.remove_duplicates(df)
    current = schema.drop_high_missing_columns(current, 0.8)
    current = text_ops.replace_error_placeholders(current, min_hits=1)
    texts = string_columns(current)
    safe = [c for c in texts if not any(w in c.lower() for w in ("email", "url", "id", "code", "date", "phone"))]
    current = text_ops.clean_special_chars(current, safe) if safe else current
    money = _mostly(current, string_columns(current), lambda c: c.rlike(CURRENCY_MARK + r"\s*-?\d"))
    current = with_exprs(current, {c: strip_to_number(col(c), r"[$€£¥₹₽₿,\s]") for c in money})
    labels = [c for c in safe if c in string_columns(current) and c not in money]
    few = _few_values(current, labels, 100)
    current = text_ops.standardise_capitalisation(current, few) if few else current
    current = schema.drop_constant_columns(current)
    current = schema.drop_index_columns(current)
    for c in _mostly(current, string_columns(current), date_like):
        current = date_ops.standardise_dates(current, c, dayfirst=False)
    current = text_ops.clean_dirty_numeric(current)
    current = missing.impute_auto(current)
    current = text_ops.trim_whitespace(current)
    current = auto_clean_columns(current)
    current = cap_outliers(current)
    texts = [c for c in string_columns(current) if c in safe]
    current = text_ops.clean_text_noise(current, texts) if texts else current
    current = domain_clean(current, domain)
    scores = quality_score(df).withColumn("stage", F.lit("before")).unionByName(
        quality_score(current).withColumn("stage", F.lit("after")))
    return current, scores


def _mostly(df: DataFrame, names: list[str], test) -> list[str]:
    """Columns where more than half of the non-null values pass the test."""
    found = []
    for part in batches(names, 20):
        exprs = []
        for i, c in enumerate(part):
            exprs += [F.count_if(test(col(c))).alias(f"h{i}"), F.count(col(c)).alias(f"n{i}")]
        row = df.agg(*exprs).first()
        found += [c for i, c in enumerate(part) if row[f"n{i}"] and row[f"h{i}"] / row[f"n{i}"] > 0.5]
    return found


def _few_values(df: DataFrame, names: list[str], limit: int) -> list[str]:
    if not names:
        return []
    row = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if 2 < row[f"d{i}"] < limit]


def apply_learned_rules(df: DataFrame, domain: str, rules: DataFrame, min_confidence: float = 0.5, column_patterns: dict | None = None) -> DataFrame:
    """Run the confident rules of a domain (and general ones) on the columns their pattern fits.

    ``rules``: ``(domain, column_pattern, action, confidence)``, a table of a domain's rules, all of them,
    that becomes plan steps on the driver.
    """
    import re

    from .learning import COLUMN_PATTERNS

    patterns = column_patterns or COLUMN_PATTERNS
    chosen = rules.where(F.col("domain").isin(domain, "general") & (F.col("confidence") >= min_confidence)).orderBy(
        F.desc("confidence"), "column_pattern", "action").collect()
    for rule in chosen:
        regex = patterns.get(rule["column_pattern"], re.escape(rule["column_pattern"]))
        for name in [c for c in df.columns if re.search(regex, c.lower())]:
            if rule["action"] in ACTIONS and name in df.columns:
                key = "columns" if rule["action"] in ("trim_whitespace", "standardise_capitalisation", "normalise_categories") else "column"
                df = apply_transformation(df, rule["action"], {key: name})
    return df

