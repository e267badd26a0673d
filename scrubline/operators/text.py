"""String cleaning: every operator is one projection unless it says otherwise."""

from __future__ import annotations

import logging

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import action, as_list, batches, chosen, col, is_string, string_columns, with_exprs
from ..functions.dates import parse_dates, parse_epoch as parse_epoch_text
from ..functions.numbers import strip_to_number, to_number
from ..functions import text as tx
from ..functions import values as fixed


def _each(df: DataFrame, columns, make) -> DataFrame:
    """Rewrite the chosen string columns in one projection."""
    names = [c for c in chosen(df, columns, string_columns(df)) if is_string(df, c)]
    return with_exprs(df, {c: make(col(c)) for c in names})


def _one(df: DataFrame, column: str, make, new_col: str | None = None) -> DataFrame:
    """Rewrite one column of any type through its text form."""
    if column not in df.columns:
        return df
    return df.withColumn(new_col or column, make(col(column).cast("string")))


def replace_all(*rules: tuple[str, str]):
    """Chain of regex replacements."""
    def make(c: Column) -> Column:
        for pattern, to in rules:
            c = F.regexp_replace(c, pattern, to)
        return c
    return make


@action("trim_whitespace", "trim_strings", row_wise=True)
def trim_whitespace(df: DataFrame, columns=None) -> DataFrame:
    return _each(df, columns, tx.squeeze)


@action("standardise_capitalisation", row_wise=True)
def standardise_capitalisation(df: DataFrame, columns=None, strategy: str = "title") -> DataFrame:
    return _each(df, columns, {"upper": F.upper, "lower": F.lower}.get(strategy, tx.title))


@action("convert_dirty_nulls", row_wise=True)
def convert_dirty_nulls(df: DataFrame, columns=None, tokens=None) -> DataFrame:
    words = list(tokens or fixed.DIRTY_NULL_TOKENS)
    return _each(df, columns, lambda c: F.when(~c.isin(words), c))


def _is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(fixed.ERROR_PLACEHOLDERS)


@action("replace_error_placeholders")
def replace_error_placeholders(df: DataFrame, min_hits: int = 3, columns=None) -> DataFrame:
    """Placeholder words become null in columns with at least ``min_hits`` of them."""
    names = [c for c in chosen(df, columns, string_columns(df)) if is_string(df, c)]
    dirty = []
    for part in batches(names, 40):
        row = df.agg(*[F.count_if(_is_placeholder(col(c))).alias(f"h{i}") for i, c in enumerate(part)]).first()
        dirty += [c for i, c in enumerate(part) if row[f"h{i}"] >= min_hits]
    return with_exprs(df, {c: F.when(~_is_placeholder(col(c)), col(c)) for c in dirty})


@action("find_replace", row_wise=True)
def find_replace(df: DataFrame, column: str, find: str = "", replace: str = "", regex: bool = False,
                 case_sensitive: bool = True) -> DataFrame:
    if not find:
        return df
    if not regex and case_sensitive:
        return _one(df, column, lambda c: F.replace(c, F.lit(find), F.lit(replace)))
    pattern = find if regex else tx.literal_pattern(find)
    to = tx.java_replacement(replace) if regex else tx.plain_replacement(replace)
    return _one(df, column, replace_all((("" if case_sensitive else "(?i)") + pattern, to)))


@action("strip_characters", row_wise=True)
def strip_characters(df: DataFrame, column=None, mode: str = "special", chars: str = "") -> DataFrame:
    if mode == "html":
        pattern = r"<[^>]+>"
    elif mode == "non_printable":
        # control, format, surrogate, private, unassigned; separators but the blank
        pattern = r"[\p{C}\p{Zl}\p{Zp}&&[^ ]]|[\p{Zs}&&[^ ]]"
    elif mode == "custom" and chars:
        pattern = tx.character_class(chars)
    else:
        pattern = r"[^a-zA-Z0-9\s]"
    return _each(df, column, lambda c: F.regexp_replace(c, pattern, ""))


@action("clean_special_chars")
def clean_special_chars(df: DataFrame, columns=None, min_share: float = 0.001) -> DataFrame:
    """Drop ``?``, the replacement character and NUL where their share is high enough."""
    names = [c for c in chosen(df, columns, string_columns(df)) if is_string(df, c)]
    pattern = "[?�\\x00]"
    dirty = []
    for part in batches(names, 40):
        exprs = []
        for i, c in enumerate(part):
            exprs += [F.count_if(col(c).rlike(pattern)).alias(f"h{i}"), F.count(col(c)).alias(f"n{i}")]
        row = df.agg(*exprs).first()
        dirty += [c for i, c in enumerate(part) if row[f"n{i}"] and row[f"h{i}"] / row[f"n{i}"] > min_share]
    return with_exprs(df, {c: tx.strip(F.regexp_replace(col(c), pattern + "+", "")) for c in dirty})


@action("clean_text_noise")
def clean_text_noise(df: DataFrame, columns=None, max_changed: float = 0.3) -> DataFrame:
    """Drop noise marks, long digit runs and URLs, squeeze repeats; only where few cells change."""
    make = lambda c: tx.squeeze(replace_all(
        (r"https?://\S+", ""), (r"[?]+", ""), (r"[@#$%^&*!]+", ""), (r"\d{10,}", ""), (r"([a-zA-Z])\1{2,}", "$1"),
    )(c))
    names = [c for c in chosen(df, columns, string_columns(df)) if is_string(df, c)]
    apply = []
    for part in batches(names, 20):
        exprs = []
        for i, c in enumerate(part):
            exprs += [F.count_if(make(col(c)) != col(c)).alias(f"h{i}"), F.count(col(c)).alias(f"n{i}")]
        row = df.agg(*exprs).first()
        apply += [c for i, c in enumerate(part) if row[f"n{i}"] and 0 < row[f"h{i}"] / row[f"n{i}"] < max_changed]
    return with_exprs(df, {c: make(col(c)) for c in apply})


@action("normalize_unicode", row_wise=True)
def normalize_unicode(df: DataFrame, column=None) -> DataFrame:
    return _each(df, column, tx.strip_accents)


MAX_FORMS = 30  # a column with more normal forms is not taken for a category column


def _canonical(df: DataFrame, name: str) -> DataFrame:
    """(key, best) of a column: the most frequent spelling of each normal form."""
    counts = df.where(col(name).isNotNull()).groupBy(col(name).alias("raw")).count()
    best = F.min_by("raw", F.struct(-F.col("count"), F.col("raw")))
    return counts.groupBy(tx.clean_key(F.col("raw")).alias("key")).agg(
        best.alias("best"), F.count("*").alias("spellings")
    )


@action("normalise_categories")
def normalise_categories(df: DataFrame, columns=None, max_forms: int | None = MAX_FORMS) -> DataFrame:
    """Map spelling variants to the most frequent one, for columns with 2 to ``max_forms`` normal forms.

    Columns with more are left as they are, with a warning that names them.
    Without a limit (None) every column is mapped, by a join with its normal forms.
    """
    names = [c for c in chosen(df, columns, string_columns(df)) if is_string(df, c)]
    if max_forms is None:
        out = df
        for name in names:
            best = _canonical(df, name).select(F.col("key").alias("_key"), F.col("best").alias("_best"))
            joined = out.join(best, tx.clean_key(col(name)) == F.col("_key"), "left")
            out = joined.select(*[F.coalesce("_best", col(c)).alias(c) if c == name else col(c) for c in df.columns])
        return out
    exprs, left = {}, []
    for name in names:
        found = _canonical(df, name).limit(max_forms + 1).collect()
        if len(found) > max_forms:
            left.append(name)
        if not 2 <= len(found) <= max_forms or all(r.spellings == 1 for r in found):
            continue
        table = F.create_map(*[F.lit(x) for r in found for x in (r.key, r.best)])
        exprs[name] = F.try_element_at(table, tx.clean_key(col(name)))
    if left:
        logging.getLogger(__name__).warning("more than %d normal forms, left as they are: %s", max_forms, ", ".join(left))
    return with_exprs(df, exprs)


@action("normalise_categories_shared")
def normalise_categories_shared(df: DataFrame, columns) -> DataFrame:
    """One spelling per normal form across several columns."""
    names = [c for c in as_list(columns) if c in df.columns]
    long = df.select(*[col(c).cast("string").alias(c) for c in names]).unpivot([], names, "_column", "_v")
    best = _canonical(long, "_v").select(F.col("key").alias("_key"), F.col("best").alias("_best"))
    out = df
    for name in names:
        on = tx.clean_key(col(name)) == F.col("_key")
        out = out.join(best, on, "left").select(
            *[F.col("_best").alias(c) if c == name else col(c) for c in df.columns]
        )
    return out


@action("extract_numeric", row_wise=True)
def extract_numeric(df: DataFrame, column: str) -> DataFrame:
    """First number in the text, thousands commas dropped."""
    return _one(df, column, lambda c: F.regexp_substr(
        F.replace(c, F.lit(",")), F.lit(r"-?\d+(\.\d+)?")).try_cast("double"))


@action("parse_currency", row_wise=True)
def parse_currency(df: DataFrame, column: str, new_col: str | None = None) -> DataFrame:
    return _one(df, column, lambda c: strip_to_number(
        F.regexp_substr(c, F.lit(r"[-+]?\s?[$€£¥₹₽]?\s?-?[\d,]+\.?\d*")), r"[^\d.\-]"),
        new_col or f"{column}_amount")


@action("parse_number_formatted", row_wise=True)
def parse_number_formatted(df: DataFrame, column: str, decimal_format: str = "us",
                           new_col: str | None = None) -> DataFrame:
    def make(c):
        if decimal_format == "eu":
            return to_number(F.replace(F.regexp_replace(c, r"[.\s]", ""), F.lit(","), F.lit(".")))
        return to_number(F.replace(c, F.lit(",")))
    return _one(df, column, make, new_col or f"{column}_parsed")


@action("clean_dirty_numeric")
def clean_dirty_numeric(df: DataFrame, columns=None) -> DataFrame:
    """Strip currency, units and quotes; where most cells are numbers, cast and fill with the median."""
    from .missing import medians

    names = [c for c in chosen(df, columns, string_columns(df)) if is_string(df, c)]

    def number(c):
        return to_number(F.trim(replace_all((r"[$€£¥₹]", ""), (r"(?i)\s*(lbs?|kg|units?).*$", ""), ('"', ""))(col(c))))

    mostly = []
    for part in batches(names, 40):
        row = df.agg(F.count("*").alias("n"), *[F.count(number(c)).alias(f"h{i}") for i, c in enumerate(part)]).first()
        mostly += [c for i, c in enumerate(part) if row.n and row[f"h{i}"] / row.n > 0.5]
    found = medians(df, {c: number(c) for c in mostly}) if mostly else {}
    return with_exprs(df, {c: F.coalesce(number(c), F.lit(found[c])) for c in mostly})


@action("parse_percentage", row_wise=True)
def parse_percentage(df: DataFrame, column: str, as_fraction: bool = True, new_col: str | None = None) -> DataFrame:
    def make(c):
        value = strip_to_number(c, r"[%,\s]")
        return value / 100 if as_fraction else value
    return _one(df, column, make, new_col)


@action("parse_scientific", row_wise=True)
def parse_scientific(df: DataFrame, columns) -> DataFrame:
    return with_exprs(df, {c: to_number(col(c)) for c in as_list(columns) if c in df.columns})


@action("strip_leading_zeros", row_wise=True)
def strip_leading_zeros(df: DataFrame, column: str, keep_one: bool = False) -> DataFrame:
    def make(c):
        cut = F.regexp_replace(c, "^0+", "")
        return F.when(cut == "", "0").otherwise(cut) if keep_one else cut
    return _one(df, column, make)


@action("normalize_boolean", row_wise=True)
def normalize_boolean(df: DataFrame, column: str) -> DataFrame:
    def make(c):
        key = tx.clean_key(c)
        return F.when(key.isin(fixed.BOOLEAN_TRUE), True).when(key.isin(fixed.BOOLEAN_FALSE), False)
    return _one(df, column, make)


@action("normalize_phone", row_wise=True)
def normalize_phone(df: DataFrame, column: str, country_code: str = "") -> DataFrame:
    """Digits only; a leading + is kept, otherwise the country code is put in front."""
    def make(c):
        digits = F.regexp_replace(c, r"\D", "")
        return F.when(tx.strip(c).startswith("+"), F.concat(F.lit("+"), digits)).otherwise(
            F.concat(F.lit(country_code), digits))
    return _one(df, column, make)


@action("extract_email_domain", row_wise=True)
def extract_email_domain(df: DataFrame, column: str, new_col: str | None = None) -> DataFrame:
    return _one(df, column, lambda c: F.nullif(F.regexp_extract(c, "@([^@]+)", 1), F.lit("")),
                new_col or f"{column}_domain")


@action("extract_url_parts", row_wise=True)
def extract_url_parts(df: DataFrame, column: str, parts=("domain", "path", "protocol")) -> DataFrame:
    if column not in df.columns:
        return df
    c = col(column).cast("string")
    pattern = {
        "domain": r"https?://([^/]+)",
        "path": r"https?://[^/]+(/[^?]*)",
        "protocol": r"(https?)://",
    }
    return with_exprs(df, {
        f"{column}_{p}": F.nullif(F.regexp_extract(c, pattern[p], 1), F.lit("")) for p in as_list(parts) if p in pattern
    })


@action("clean_urls", row_wise=True)
def clean_urls(df: DataFrame, column: str, strip_params: bool = True) -> DataFrame:
    rules = [(r"\?.*", "")] if strip_params else []
    rules += [("^https?://", ""), (r"^www\.", ""), ("/+$", "")]
    return _one(df, column, lambda c: replace_all(*rules)(tx.strip(c)))


@action("clean_emails", row_wise=True)
def clean_emails(df: DataFrame, column: str, lowercase: bool = True) -> DataFrame:
    return _one(df, column, lambda c: F.regexp_replace(F.lower(c) if lowercase else c, r"(?U)\s+", ""))


@action("clean_html", row_wise=True)
def clean_html(df: DataFrame, column: str) -> DataFrame:
    return _one(df, column, lambda c: tx.squeeze(F.regexp_replace(c, "<[^>]+>", " ")))


@action("clean_log_lines", row_wise=True)
def clean_log_lines(df: DataFrame, column: str) -> DataFrame:
    return _one(df, column, lambda c: replace_all(
        (r"\[.*?\]", ""), ("ERROR|WARN|INFO|DEBUG", ""), (r"(?U)\s+", " "))(tx.strip(c)))


@action("clean_names", row_wise=True)
def clean_names(df: DataFrame, column: str) -> DataFrame:
    """Collapse blanks, title case, initials without their dot."""
    return _one(df, column, lambda c: F.regexp_replace(tx.title(tx.squeeze(c)), r"([A-Z])\.", "$1"))


@action("clean_addresses", row_wise=True)
def clean_addresses(df: DataFrame, column: str, abbreviate: bool = False) -> DataFrame:
    """Collapse blanks and empty parts, title case; optionally short street types."""
    def make(c):
        text = F.regexp_replace(tx.squeeze(c), r",\s*,", ",")
        if abbreviate:
            text = replace_all(*[("(?i)" + p, to) for p, to in fixed.STREET_TYPES.items()])(text)
        return tx.title(text)
    return _one(df, column, make)


@action("clean_city", row_wise=True)
def clean_city(df: DataFrame, column: str) -> DataFrame:
    return _one(df, column, lambda c: F.nullif(tx.title(F.regexp_replace(tx.strip(c), r"[^a-zA-Z\s\-]", "")), F.lit("")))


@action("clean_postal_codes", row_wise=True)
def clean_postal_codes(df: DataFrame, column: str, country: str = "US") -> DataFrame:
    def make(c):
        if country == "US":
            digits = F.regexp_replace(c, r"\D", "")
            return F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)
        return F.upper(F.regexp_replace(c, r"(?U)\s+", ""))
    return _one(df, column, make)


# --- fixed values: characters a code may keep --------------------------------
_CODE_DROP = {
    "iban": r"\s+", "sku": r"\s+", "tracking": r"\s+",
    "ICD10": r"[^A-Z0-9.]", "CPT": r"[^0-9]", "NDC": r"[^0-9\-]",
}
# --- end of fixed values -----------------------------------------------------


@action("clean_codes", row_wise=True)
def clean_codes(df: DataFrame, column: str, kind: str = "sku") -> DataFrame:
    return _one(df, column, lambda c: F.regexp_replace(F.upper(tx.strip(c)), _CODE_DROP[kind], ""))


@action("clean_handles", row_wise=True)
def clean_handles(df: DataFrame, column: str, platform: str = "twitter") -> DataFrame:
    """Social handles: no leading @ (twitter, instagram), lower case."""
    at = "^@" if platform in ("twitter", "instagram") else r"^(?!.)"
    return _one(df, column, lambda c: F.lower(F.regexp_replace(tx.strip(c), at, "")))


def _degrees(c: Column, negative: str) -> Column:
    """Degrees, minutes, seconds and hemisphere letter -> signed decimal degrees."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*[°D]?\s*(?:(\d+(?:\.\d+)?)\s*['′]?\s*)?(?:(\d+(?:\.\d+)?)\s*[\"″]?\s*)?([NSEW])?\s*$"
    s = F.upper(c)
    part = [F.coalesce(F.regexp_extract(s, pattern, i).try_cast("double"), F.lit(0.0)) for i in (1, 2, 3)]
    value = part[0] + part[1] / 60 + part[2] / 3600
    sign = F.when(F.regexp_extract(s, pattern, 4) == negative, -1.0).otherwise(1.0)
    return F.when(s.rlike(pattern), value * sign)


@action("parse_coordinates", row_wise=True)
def parse_coordinates(df: DataFrame, latitude: str | None = None, longitude: str | None = None,
                      lat_format: str = "decimal", lon_format: str = "decimal") -> DataFrame:
    exprs = {}
    for name, form, negative in ((latitude, lat_format, "S"), (longitude, lon_format, "W")):
        if name in df.columns:
            c = col(name).cast("string")
            exprs[name] = _degrees(c, negative) if form == "dms" else to_number(c)
    return with_exprs(df, exprs)


@action("extract_regex_groups", row_wise=True)
def extract_regex_groups(df: DataFrame, column: str, pattern: str, group_names=()) -> DataFrame:
    """Capture groups of the first match as columns, null without a match."""
    groups = re.compile(pattern).groups
    names = as_list(group_names)[:groups]
    names += [str(i) for i in range(len(names), groups)]
    c = col(column).cast("string")
    return with_exprs(df, {
        n: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i + 1)) for i, n in enumerate(names)
    })


@action("tokenize_text", row_wise=True)
def tokenize_text(df: DataFrame, column: str, delimiter: str = " ", new_col: str | None = None) -> DataFrame:
    return _one(df, column, lambda c: F.split(c, tx.literal_pattern(delimiter), -1), new_col or f"{column}_tokens")


@action("remove_stopwords", row_wise=True)
def remove_stopwords(df: DataFrame, column=None, language: str = "english") -> DataFrame:
    words = fixed.STOPWORDS.get(language, fixed.STOPWORDS["english"])
    return _each(df, column, lambda c: F.array_join(
        F.filter(F.split(tx.squeeze(c), " "), lambda w: ~F.lower(w).isin(words)), " "))


@action("detect_encoding")
def detect_encoding(df: DataFrame, column: str) -> DataFrame:
    """Character profile of a text column: shares of ASCII, non-ASCII, broken and control text."""
    c = col(column)
    kinds = {
        "ascii": ~c.rlike(r"[^\x00-\x7F]"),
        "non_ascii": c.rlike(r"[^\x00-\x7F]"),
        "broken": c.rlike("�|Ã[\u0080-¿]|â€"),
        "control": c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"),
    }
    counted = df.agg(F.count(c).alias("n"), *[F.count_if(t).alias(k) for k, t in kinds.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("hits")) for k in kinds])
    return counted.select(F.explode(pairs).alias("p"), "n").select(
        F.lit(column).alias("column"), "p.kind", "p.hits", F.try_divide(F.col("p.hits"), F.col("n")).alias("share"))


def vocabulary_expr(c: Column, vocab: str) -> Column:
    if vocab not in fixed.VOCABULARIES:
        raise ValueError(f"unknown vocabulary: {vocab}")
    pairs = fixed.VOCABULARIES[vocab]
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(table, tx.clean_key(c))


@action("map_to_standard", row_wise=True)
def map_to_standard(df: DataFrame, column: str, vocab: str, unmapped: str = "keep") -> DataFrame:
    """Standard vocabulary; unmapped values are kept, blanked, or raise when the job runs."""
    c = col(column).cast("string")
    mapped = vocabulary_expr(c, vocab)
    if unmapped == "keep":
        mapped = F.coalesce(mapped, c)
    elif unmapped == "error":
        fail = F.raise_error(F.concat(F.lit(f"{column}: no {vocab} entry for "), c)).cast("string")
        mapped = F.when(c.isNull(), None).when(mapped.isNotNull(), mapped).otherwise(fail)
    return df.withColumn(column, mapped)


def mapping_counts(df: DataFrame, column: str, vocab: str) -> DataFrame:
    hit = vocabulary_expr(col(column).cast("string"), vocab).isNotNull()
    return df.where(col(column).isNotNull()).agg(
        F.count_if(hit).alias("mapped"), F.count_if(~hit).alias("unmapped"))


def preview_mapping(df: DataFrame, column: str, vocab: str) -> DataFrame:
    """Distinct values with what they map to."""
    values = df.select(col(column).cast("string").alias("original")).where("original is not null").distinct()
    mapped = values.withColumn("mapped", vocabulary_expr(F.col("original"), vocab))
    return mapped.withColumn("status", F.when(F.col("mapped").isNull(), "unmapped").otherwise("mapped"))


@action("validate_json", row_wise=True)
def validate_json(df: DataFrame, column: str, flag_col: str | None = None) -> DataFrame:
    """True for exactly one JSON value.

    The JSON readers stop after the first value, so the text is also read as the
    only element of an array and as a member of an object.
    """
    c = col(column).cast("string")
    alone = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    member = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull()
    return df.withColumn(flag_col or f"{column}_is_json", F.coalesce(alone & member, F.lit(False)))


@action("flatten_json")
def flatten_json(df: DataFrame, column: str, target: str | None = None, max_keys: int | None = None) -> DataFrame:
    """Top-level keys as text columns ``<target>_<key>``, all of them unless ``max_keys`` is given.

    The keys are counted over the whole column, so the choice of the
    ``max_keys`` most frequent ones does not depend on row order.
    """
    target = target or column
    parsed = F.from_json(col(column), T.MapType(T.StringType(), T.StringType()))
    found = df.select(F.explode(F.map_keys(parsed)).alias("k")).groupBy("k").count().orderBy(F.desc("count"), "k")
    keys = [r.k for r in (found if max_keys is None else found.limit(max_keys)).collect()]
    return with_exprs(df, {f"{target}_{k}": F.try_element_at(parsed, F.lit(k)) for k in keys})


@action("clean_mixed_formats", row_wise=True)
def clean_mixed_formats(df: DataFrame, column: str, target_type: str = "string") -> DataFrame:
    make = {"numeric": to_number, "datetime": lambda c: parse_dates(c, False)}.get(target_type, tx.strip)
    return _one(df, column, make)


@action("parse_epoch", row_wise=True)
def parse_epoch(df: DataFrame, column: str) -> DataFrame:
    return _one(df, column, parse_epoch_text)
