"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.plans.sqlbase import SHIFT, r6, with_tables
from castwise.plans.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, so that values do not depend on the order of summation.

    A small shift moves the rounding point off the decimal halves: values of simple
    windows land exactly there, and the last bit would decide.
    """
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        out.append(F.round(c + SHIFT, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), extra: dict[str, str] | None = None):
    """Register ``fn(ws) -> DataFrame``; ``doubles`` are the SQL columns to round."""

    def register(fn: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(workspace(spark, sf_dir)))
        if sql is not None:
            body = sql
            if doubles:
                replaced = ", ".join(f'{r6(chr(34) + c + chr(34))} AS "{c}"' for c in doubles)
                body = f"SELECT * REPLACE ({replaced}) FROM ({sql})"
            ORACLES[name] = with_tables(body, extra)
        return fn

    return register
