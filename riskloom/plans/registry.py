"""Query registry: name -> (Spark builder, DuckDB oracle SQL).

Spark builders take ``(spark, sf_dir)`` and return a lazy DataFrame. Floating
columns are rounded to 6 decimals on both sides, since summation order differs
between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.exprs import round_doubles
from riskloom.plans.fixture_sql import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def oracle(sql: str, doubles: tuple[str, ...] | list[str] = (),
           extra: dict[str, str] | None = None) -> str:
    """Wrap ``sql`` with fixture CTEs and round the named floating columns."""
    body = with_views(sql, extra)
    if doubles:
        rep = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in doubles)
        body = f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) AS _q"
    return body


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] | list[str] = (),
             extra: dict[str, str] | None = None):
    """Decorator: register a Spark query and (optionally) its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn, _cols=tuple(doubles)) -> DataFrame:
            # Round exactly the columns the oracle rounds: values both engines
            # compute bit-identically (products of identical inputs) stay raw.
            return round_doubles(_fn(spark, sf_dir), DIGITS, only=_cols if sql is not None else None)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = oracle(sql, doubles, extra)
        return fn
    return deco


MODULES = ["q_scoring", "q_profile", "q_clean", "q_features", "q_metrics", "q_explain", "q_alerts", "q_velocity", "q_anomaly", "q_models", "q_io"]


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"riskloom.plans.{m}")
