"""Text expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Strip, and make every run of white space one blank."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def title(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest.

    ``initcap`` starts words at blanks only, so the text is cut after each
    non-letter and every piece gets a capital first character.
    """
    pieces = F.split(F.lower(c), r"(?<=\P{L})")
    return F.array_join(
        F.transform(
            pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
        ),
        "",
    )


def clean_key(c: Column) -> Column:
    """Comparison key of a category value: stripped lower case."""
    return F.lower(strip(c))


def literal_pattern(text: str) -> str:
    """Java regex that matches ``text`` literally."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def character_class(chars: str) -> str:
    return "[" + "".join("\\" + ch if not ch.isalnum() else ch for ch in chars) + "]"


def java_replacement(text: str) -> str:
    r"""Turn back references ``\1`` or ``\g<1>`` into ``$1``; protect a literal ``$``."""
    text = text.replace("$", r"\$")
    return re.sub(r"\\g<(\d+)>|\\(\d+)", lambda m: "$" + (m.group(1) or m.group(2)), text)


def plain_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", r"\$")


def sorted_tokens(c: Column) -> Column:
    """Words in sorted order joined by one blank (key of token-sort scores)."""
    return F.array_join(F.array_sort(F.split(squeeze(c), " ")), " ")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def contains_any(c: Column, words: list[str]) -> Column:
    test = F.contains(c, F.lit(words[0]))
    for word in words[1:]:
        test = test | F.contains(c, F.lit(word))
    return test


def strip_accents(c: Column) -> Column:
    """NFKD form without combining marks.  Spark has no built-in for it.

    The function is nested so that it travels to executors by value.
    """
    def plain(text):
        if text is None or text.isascii():
            return text
        return "".join(
            ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)
        )

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(plain)

    return F.pandas_udf(batch, StringType())(c)
