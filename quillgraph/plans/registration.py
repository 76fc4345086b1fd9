"""How query modules register: a function over the model, with its SQL over the model's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.plans.model import Model, oracle


def registrar() -> tuple[dict, dict[str, str], Callable]:
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, *needs: str):
        def add(f):
            queries[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
            queries[f.__name__].__doc__ = f.__doc__
            if sql is not None:
                oracles[f.__name__] = oracle(sql, *needs)
            return f

        return add

    return queries, oracles, query


def r6(column: Column | str, name: str | None = None) -> Column:
    return F.round(column, 6).alias(name or column)
