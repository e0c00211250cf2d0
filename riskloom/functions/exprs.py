"""Column-expression helpers shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-9


def col_sum(cols: list[Column]) -> Column:
    """Left-to-right sum (same association as a Python loop)."""
    return reduce(lambda a, b: a + b, cols)


def greatest(cols: list[Column]) -> Column:
    """``greatest`` that accepts one argument (Spark needs two or more). Skips NULL."""
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def least(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN -> NULL for every floating column: one notion of missing, as pandas has."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_doubles(df: DataFrame, digits: int = 6, only=None) -> DataFrame:
    """Round floating columns for comparison with an oracle (summation order differs).
    ``only``: restrict to these columns (None = every floating column)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (only is None or f.name in only):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def q(name: str) -> str:
    """Backtick-quote a column name for SQL-expression strings."""
    return "`" + name.replace("`", "``") + "`"
