"""Date parsing without Python: a chain of guarded format attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# strftime letter -> Spark pattern letters
_STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss",
    "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh", "j": "DDD",
}


def spark_format(strftime: str) -> str:
    out, i = "", 0
    while i < len(strftime):
        ch = strftime[i]
        if ch == "%" and i + 1 < len(strftime):
            out += _STRFTIME.get(strftime[i + 1], strftime[i + 1])
            i += 2
        else:
            out += "'" + ch + "'" if ch.isalpha() else ch
            i += 1
    return out


_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_M, _D = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
DATE_LIKE = (
    rf"(?i)^\s*(?:\d{{4}}[-/.]{_M}[-/.]{_D}(?:[ T].*)?|{_D}[-/.]{_M}[-/.]\d{{4}}(?: .*)?|{_M}[-/.]{_D}[-/.]\d{{4}}(?: .*)?"
    rf"|{_MONTH} {_D},? \d{{4}}|{_D} {_MONTH},? \d{{4}})\s*$"
)


def date_like(c: Column) -> Column:
    """Cheap test for date layouts: one pattern instead of a parse, for share counts."""
    return c.rlike(DATE_LIKE)


def parse_dates(c: Column, dayfirst: bool = True) -> Column:
    """Text in any of the common layouts -> TIMESTAMP_NTZ, null if none fits.

    Year-first text is never read day-first.  Each attempt is guarded by a cheap
    pattern, so the costly failing parse happens only for impossible dates.
    """
    s = F.regexp_replace(F.trim(c), r"\s+", " ")
    date = F.regexp_replace(F.split_part(s, F.lit(" "), F.lit(1)), "[-.]", "/")
    clock = F.regexp_extract(s, r"[ T](\d{1,2}:\d{2}(?::\d{2})?)", 1)
    seconds = F.when(clock.rlike(r":\d{2}:"), clock).otherwise(
        F.when(clock != "", F.concat(clock, F.lit(":00"))).otherwise(F.lit("0:00:00"))
    )

    def numeric(pattern):
        return F.try_to_timestamp(F.concat_ws(" ", date, seconds), F.lit(pattern + " H:mm:ss"))

    day, month = numeric("d/M/yyyy"), numeric("M/d/yyyy")
    words = F.initcap(F.regexp_replace(F.regexp_replace(s, r"(\d)(st|nd|rd|th)\b", "$1"), "[,/.-]+ ?", " "))

    def named(pattern):
        return F.try_to_timestamp(words, F.lit(pattern))

    parsed = (
        F.when(
            s.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"), F.try_to_timestamp(date, F.lit("yyyy/M/d"))
        )
        .when(
            s.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}[ T]"),
            F.try_to_timestamp(
                F.concat_ws(" ", F.regexp_replace(F.regexp_extract(s, r"^[\d/.-]+", 0), "[-.]", "/"), seconds),
                F.lit("yyyy/M/d H:mm:ss"),
            ),
        )
        .when(
            s.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}( \d{1,2}:\d{2}(:\d{2})?)?$"),
            F.coalesce(day, month) if dayfirst else F.coalesce(month, day),
        )
        .when(s.rlike(r"^\d{13}$"), F.timestamp_millis(s.try_cast("long")))
        .when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(s.try_cast("long")))
        .when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")))
        .when(words.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{4}$"), named("MMM d yyyy"))
        .when(words.rlike(r"^[A-Z][a-z]{3,} \d{1,2} \d{4}$"), named("MMMM d yyyy"))
        .when(words.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"), named("d MMM yyyy"))
        .when(words.rlike(r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$"), named("d MMMM yyyy"))
    )
    return parsed.cast("timestamp_ntz")


def as_timestamp(df, name: str, dayfirst: bool = True) -> Column:
    """Timestamp of a column: parsed when it is text, cast when it is temporal."""
    from ..core import col, is_temporal

    if is_temporal(df, name):
        return col(name).cast("timestamp_ntz")
    return parse_dates(col(name).cast("string"), dayfirst)


def whole_days(a: Column, b: Column) -> Column:
    """Days from b to a, rounded down (also below zero)."""
    micros = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def parse_epoch(c: Column) -> Column:
    """10 digits = seconds, 13 digits = milliseconds -> text; others unchanged."""
    s = F.trim(c.cast("string"))
    return (
        F.when(s.rlike(r"^\d{13}$"), F.date_format(F.timestamp_millis(s.try_cast("long")), "yyyy-MM-dd HH:mm:ss"))
        .when(s.rlike(r"^\d{10}$"), F.date_format(F.timestamp_seconds(s.try_cast("long")), "yyyy-MM-dd HH:mm:ss"))
        .otherwise(c.cast("string"))
    )
