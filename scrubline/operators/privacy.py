"""Personal data: detection, masking, hashing, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import action, as_list, col
from ..functions import values as fixed

# --- fixed values: inventory types -> (pattern, category, sensitivity) --------
INVENTORY = {
    "email": (r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "personal", 0.8),
    "phone": (r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "personal", 0.7),
    "ssn": (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "sensitive", 1.0),
    "credit_card": (r"\b(?:\d[ -]?){13,16}\b", "financial", 1.0),
    "ip_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "location", 0.5),
    "dob": (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "personal", 0.6),
    "address": (
        r"(?i)\b\d+\s+[\w\s]+(?:street|st|avenue|ave|road|rd| boulevard|blvd)\b", "location", 0.7),
}
INVENTORY_NAMES = {
    "name": (["name", "first", "last", "full", "customer", "user", "client"], "personal", 0.8),
    "age": (["age", "dob", "birth", "years"], "personal", 0.3),
}
# --- end of fixed values -----------------------------------------------------


def _name_type(name: str):
    lowered = name.lower()
    for kind, confidence, words in fixed.PII_NAME_WORDS:
        if any(w in lowered for w in words):
            return kind, confidence
    return None


def detect_pii(df: DataFrame, min_share: float = 0.5) -> DataFrame:
    """``(column, pii_type, confidence, match_count)`` of columns that look personal.

    The column name decides first, then the first pattern that at least half of
    all non-null values contain.  Every value is looked at, in one aggregate.
    """
    exprs, named = [], {}
    for i, name in enumerate(df.columns):
        exprs.append(F.count(col(name)).alias(f"n{i}"))
        hit = _name_type(name)
        if hit:
            named[i] = hit
            continue
        text = col(name).cast("string")
        exprs += [F.count_if(text.rlike(p)).alias(f"p{i}_{k}") for k, p in fixed.PII_PATTERNS.items()]
    counted = df.agg(*exprs)
    items = []
    for i, name in enumerate(df.columns):
        total = F.col(f"n{i}")
        if i in named:
            kind, confidence = F.lit(named[i][0]), F.lit(named[i][1])
            matches = total
        else:
            kind = confidence = matches = None
            for k in reversed(list(fixed.PII_PATTERNS)):
                found = F.col(f"p{i}_{k}")
                enough = (total > 0) & (found >= total * min_share)
                kind = F.when(enough, F.lit(k)).otherwise(kind if kind is not None else F.lit(None).cast("string"))
                share = F.round(found / total, 2)
                confidence = F.when(enough, share).otherwise(
                    confidence if confidence is not None else F.lit(None).cast("double"))
                matches = F.when(enough, found).otherwise(matches if matches is not None else F.lit(0))
        items.append(F.struct(
            F.lit(name).alias("column"), kind.cast("string").alias("pii_type"),
            confidence.cast("double").alias("confidence"), matches.cast("long").alias("match_count")))
    return counted.select(F.inline(F.array(*items))).where("pii_type is not null")


def scan_pii_inventory(df: DataFrame) -> DataFrame:
    """``(column, pii_type, category, sensitivity)``: first type with matches above 10 % of the values."""
    names = df.columns
    exprs = []
    for i, name in enumerate(names):
        text = col(name).cast("string")
        exprs.append(F.count(text).alias(f"n{i}"))
        exprs += [F.sum(F.regexp_count(text, F.lit(p))).alias(f"p{i}_{k}") for k, (p, _c, _s) in INVENTORY.items()]
    counted = df.agg(*exprs)
    items = []
    for i, name in enumerate(names):
        kind = F.lit(None).cast("string")
        for k, (words, _c, _s) in reversed(INVENTORY_NAMES.items()):
            if any(w in name.lower() for w in words):
                kind = F.lit(k)
        for k in reversed(list(INVENTORY)):
            kind = F.when(F.col(f"p{i}_{k}") > F.col(f"n{i}") * 0.1, F.lit(k)).otherwise(kind)
        items.append(F.struct(F.lit(name).alias("column"), kind.alias("pii_type")))
    found = counted.select(F.inline(F.array(*items))).where("pii_type is not null")
    config = {k: (c, s) for k, (_p, c, s) in (INVENTORY | INVENTORY_NAMES).items()}
    category = F.create_map(*[F.lit(x) for k, (c, _s) in config.items() for x in (k, c)])
    sensitivity = F.create_map(*[F.lit(x) for k, (_c, s) in config.items() for x in (k, s)])
    return found.select("column", "pii_type", category[F.col("pii_type")].alias("category"),
                        sensitivity[F.col("pii_type")].alias("sensitivity"))


def _pick(seed: Column, choices: list[str], step: int = 1) -> Column:
    words = F.array(*[F.lit(w) for w in choices])
    return F.element_at(words, (F.pmod(F.floor(seed / step), F.lit(len(choices))) + 1).cast("int"))


def _fake(c: Column, pii_type: str) -> Column:
    """Plausible replacement that depends only on the value.

    The seed is the first 13 hex digits of its MD5, a number below 2**52.
    """
    seed = F.conv(F.substring(F.md5(c), 1, 13), 16, 10).cast("long")

    def digits(number: Column, width: int) -> Column:
        return F.lpad(number.cast("string"), width, "0")

    if pii_type == "email":
        user = F.concat(_pick(seed, fixed.FAKE_USERS), F.pmod(seed, F.lit(999)).cast("string"))
        return F.concat(user, F.lit("@"), _pick(seed, fixed.FAKE_DOMAINS, 100))
    if pii_type == "phone":
        return F.concat(F.lit("+1-"), digits(F.pmod(seed, F.lit(10_000_000_000)), 10))
    if pii_type == "ssn":
        a, b, d = (F.pmod(seed, F.lit(m)) + o for m, o in ((899, 100), (89, 10), (8999, 1000)))
        return F.concat_ws("-", digits(a, 3), digits(b, 2), digits(d, 4))
    if pii_type == "credit_card":
        n = (F.pmod(seed, F.lit(9_000_000_000_000_000)) + 1_000_000_000_000_000).cast("string")
        return F.concat_ws("-", *[F.substring(n, i, 4) for i in (1, 5, 9, 13)])
    if pii_type == "ip_address":
        parts = [(F.pmod(F.floor(seed / 254**k), F.lit(254)) + 1).cast("string") for k in range(3)]
        return F.concat_ws(".", F.lit("10"), *parts)
    if pii_type == "name":
        return F.concat_ws(" ", _pick(seed, fixed.FAKE_FIRST), _pick(seed, fixed.FAKE_LAST, 10))
    if pii_type == "date_of_birth":
        y, m, d = F.pmod(seed, F.lit(55)) + 1950, F.pmod(seed, F.lit(12)) + 1, F.pmod(seed, F.lit(28)) + 1
        return F.concat_ws("-", digits(y, 4), digits(m, 2), digits(d, 2))
    return _hash(c)


def _hash(c: Column) -> Column:
    return F.concat(F.lit("HASH_"), F.left(F.sha2(c, 256), F.lit(8)))


@action("mask_pii", row_wise=True)
def mask_pii(df: DataFrame, column: str, pii_type: str, strategy: str = "redact") -> DataFrame:
    """redact (label token), hash, or fake; null and blank values stay."""
    if column not in df.columns:
        return df
    text = col(column).cast("string")
    masked = {
        "hash": lambda: _hash(text),
        "fake": lambda: _fake(text, pii_type),
    }.get(strategy, lambda: F.lit(fixed.REDACTION_LABELS.get(pii_type, "[REDACTED]")))()
    return df.withColumn(column, F.when(text.isNull() | (F.trim(text) == ""), text).otherwise(masked))


# longer, more specific forms first, so that a card number is not taken for a phone
_TEXT_ORDER = ["email", "credit_card", "ssn", "ip_address", "phone", "postcode_uk", "postcode_us"]


@action("mask_pii_in_text", row_wise=True)
def mask_pii_in_text(df: DataFrame, column: str, types=None) -> DataFrame:
    """Replace every match inside free text by its label."""
    wanted = [t for t in _TEXT_ORDER if t in (as_list(types) or _TEXT_ORDER)]
    text = col(column).cast("string")
    for kind in wanted:
        masked = F.regexp_replace(text, fixed.PII_PATTERNS[kind], fixed.REDACTION_LABELS[kind])
        # texts without an @ cannot hold an address: skip the slowest pattern
        text = F.when(F.contains(text, F.lit("@")), masked).otherwise(text) if kind == "email" else masked
    return df.withColumn(column, text)


def pii_counts_in_text(df: DataFrame, column: str, types=None) -> DataFrame:
    """Rows and matches per type in a text column."""
    wanted = as_list(types) or list(fixed.PII_PATTERNS)
    text = col(column).cast("string")
    exprs = []
    for k in wanted:
        pattern = F.lit(fixed.PII_PATTERNS[k])
        exprs += [F.count_if(text.rlike(fixed.PII_PATTERNS[k])).alias(f"r_{k}"),
                  F.sum(F.regexp_count(text, pattern)).alias(f"m_{k}")]
    items = F.array(*[
        F.struct(F.lit(k).alias("pii_type"), F.col(f"r_{k}").alias("rows"), F.col(f"m_{k}").alias("matches"))
        for k in wanted
    ])
    return df.agg(*exprs).select(F.inline(items))


@action("hash_ids", row_wise=True)
def hash_ids(df: DataFrame, column: str, salt: str = "") -> DataFrame:
    """First 16 hex digits of the salted SHA-256."""
    digest = F.sha2(F.concat(F.lit(salt), col(column).cast("string")), 256)
    return df.withColumn(column, F.left(digest, F.lit(16)))


@action("apply_retention", row_wise=True)
def apply_retention(df: DataFrame, ts_col: str, days: int, as_of: str | None = None) -> DataFrame:
    """Keep rows not older than the policy; rows without a time are kept."""
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")
    limit = now - F.make_interval(days=F.lit(days))
    old = col(ts_col).cast("timestamp_ntz") < limit
    return df.where(F.coalesce(~old, F.lit(True)))

