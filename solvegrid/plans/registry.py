"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adaptor import LOG, SOLVE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def over_solve(sql: str):
    return query(f"WITH {SOLVE} {sql}")


def over_log(sql: str):
    return query(f"WITH RECURSIVE {LOG} {sql}")
