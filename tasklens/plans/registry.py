"""Registered queries: one per operator of the inventory, each a function
``(spark, sf_dir) -> DataFrame`` over the driver tables, with an
independent DuckDB SQL twin in ``plans.oracle`` where SQL can express it.

Doubles are rounded to 6 places in the registered form, so that the last
bits of ``ln``/``pow``/``sqrt`` in two engines do not decide a comparison.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    """Register ``fn(spark, sf_dir)``; the registered callable first makes
    the package importable by the session's Python workers."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6, prefix: str = "") -> DataFrame:
    """Round every DOUBLE / FLOAT column (whose name starts with ``prefix``)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name.startswith(prefix):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]

