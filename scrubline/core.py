"""Shared helpers: column access, type tests and the named-action registry.

Every operator is ``op(df, **params) -> DataFrame``.  ``@action`` records it
under its public name together with the ``row_wise`` flag: a row-wise operator
uses only the values of its own row, so it needs no shuffle and runs unchanged
on a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Action:
    name: str
    function: Callable[..., DataFrame]
    row_wise: bool


ACTIONS: dict[str, Action] = {}


def action(*names: str, row_wise: bool = False):
    """Register an operator under one or more action names."""

    def register(function):
        for name in names:
            ACTIONS[name] = Action(name, function, row_wise)
        return function

    return register


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.StringType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.NumericType)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(
        data_type(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType)
    )


_PLAIN_WORD = re.compile(r"[A-Za-z0-9]+")
_CASED_WORD = re.compile(r"[A-Z]+(?![a-z])[0-9]*|[A-Z]?[a-z0-9]+|[0-9]+")


def name_words(name: str, by_case: bool = False) -> list[str]:
    """Lower-case words of a column name: runs of letters and digits, and with ``by_case`` also the humps of a run."""
    return [w.lower() for w in (_CASED_WORD if by_case else _PLAIN_WORD).findall(name)]


def as_list(names) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def chosen(df: DataFrame, columns, default: list[str]) -> list[str]:
    """Requested columns that exist, or the default set."""
    wanted = as_list(columns) or default
    return [name for name in wanted if name in df.columns]


def with_exprs(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Add or replace columns in ONE projection."""
    return df.withColumns(exprs) if exprs else df


def batches(items: list, size: int):
    """Split a wide list so that one aggregate stays small enough to compile."""
    for start in range(0, len(items), size):
        yield items[start:start + size]


def one_row(df: DataFrame, exprs: list[Column]) -> dict:
    """Run one partial+final aggregate and return its single row."""
    return df.agg(*exprs).first().asDict() if exprs else {}
