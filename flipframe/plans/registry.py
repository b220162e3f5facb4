"""Query registry: every operator id gets a Spark query and (where SQL can say it) an oracle.

Outputs are normalised the same way on both sides so the driver's value hash compares like
with like: integer columns are BIGINT, doubles are rounded to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)


REGISTRY: dict[str, Entry] = {}


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, doubles: list[str] | None = None):
    """Decorator registering a Spark query and its oracle SQL (``doubles`` are rounded there)."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from flipframe.session import ship_package

            ship_package(spark)
            return normalise(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(name, run, sql, list(doubles or []))
        return fn

    return deco


def oracle(entry: Entry) -> str | None:
    if entry.sql is None:
        return None
    if not entry.doubles:
        return entry.sql
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in entry.doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{entry.sql}\n) AS q"
