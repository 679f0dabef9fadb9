"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's values, null as empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def add_columns(df: DataFrame, make: Callable, fields: Sequence[T.StructField], keep: Sequence[str] | None = None) -> DataFrame:
    """Append columns computed per Arrow batch.

    ``make()`` runs once per task and returns a function from a batch to one Arrow array per field. ``keep`` names the
    columns passed through (all by default); one that has the name of a new column is replaced by it.
    """
    ship(df.sparkSession)
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))

    def run(batches):
        compute = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + compute(batch), names=kept + names)

    return df.mapInArrow(run, schema)


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The caller's columns as c0, c1, ..., so that no name of theirs meets one of an operator's, and the names they had."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[column(c).alias(n) for c, n in names.items()]), names


def back(df: DataFrame, names: dict[str, str], *more) -> DataFrame:
    """The caller's columns under their own names, and what is added to them."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()], *more)


def column(name: str):
    """A column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")
