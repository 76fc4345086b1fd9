"""The engine's functions by name in SQL, as temporary SQL functions: Catalyst inlines them like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A row: name, parameters, result, body.
FUNCTIONS = (
    ("dot_product", "a array<double>, b array<double>", "double", "aggregate(zip_with(a, b, (x, y) -> x * y), 0d, (s, x) -> s + x)"),
    ("vector_length", "a array<double>", "double", "sqrt(aggregate(transform(a, x -> x * x), 0d, (s, x) -> s + x))"),
    ("rating_decay", "rated_at double, as_of double", "double", "case when rated_at <= 0 then 1d else greatest(0.25d, pow(2d, -(as_of - rated_at) / 86400d / 90d)) end"),
    ("rank_fusion", "ranks array<bigint>", "double", "least(1d, aggregate(ranks, 0d, (s, r) -> s + 1d / (61 + r)) / (4d / 61))"),
    ("screening", "rating double", "string", "case when rating is null then 'skipped' when rating >= 6 then 'included' else 'excluded' end"),
    ("set_likeness", "a array<string>, b array<string>", "double", "case when size(array_union(a, b)) = 0 then 1d else size(array_intersect(a, b)) / size(array_union(a, b)) end"),
)


def register(spark: SparkSession) -> list[str]:
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    return [f[0] for f in FUNCTIONS]
