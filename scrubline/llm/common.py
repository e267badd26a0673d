"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space as the word definitions of the contracts have it
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def default_path(name: str) -> str:
    """Place of a public tokenizer file; every operator also takes a path of its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_bytes(spark: SparkSession, path: str):
    """A vocabulary file (a few MB, fixed) as a broadcast variable, so that workers need no path."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _reach_package(spark: SparkSession) -> None:
    """Let local workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of equally long columns."""
    _reach_package(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays(
                [columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of the table has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def text_of(df: DataFrame, column: str = "text"):
    """The text column as string, null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
