"""Registers a query under its function's name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    """body after the expressions for quads and types, and after ctes."""
    head = dataset.CTE.replace("WITH", "WITH RECURSIVE", 1) if recursive else dataset.CTE
    return ",\n".join([head, *ctes]) + "\n" + body


def query(oracle: str | None = None):
    def add(make):
        QUERIES[make.__name__] = make
        if oracle is not None:
            ORACLE_SQL[make.__name__] = oracle
        return make

    return add
