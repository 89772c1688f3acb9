"""Constraints on rows, summaries of test runs, paired comparisons and cursors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(tests: dict[str, Column]) -> Column:
    """Names of the constraints that a row breaks, in order; a test that is null is broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())


def run_summary(tests: DataFrame, passed: Column, by: list[str]) -> DataFrame:
    """(by..., tests, passed, rate): passed tests in all, and by each of the columns alone; a column is null where it isn't the one."""
    rows = tests.select(*by, passed.cast("int").alias("_p"))
    one = lambda keep: rows.groupBy(*keep).agg(F.count("*").alias("tests"), F.sum("_p").alias("passed")).select(*[F.col(c) if c in keep else F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in by], "tests", "passed")
    every = reduce(DataFrame.unionByName, [one([c]) for c in by], one([]))
    return every.withColumn("rate", F.when(F.col("tests") > 0, F.col("passed") / F.col("tests") * 100).otherwise(0.0))


def paired(one: DataFrame, other: DataFrame, key: str, tolerance: float = 0.05) -> DataFrame:
    """One row: keys that both have, wins of either by value (less is better), ties within tolerance of the larger, and the mean difference in per cent."""
    both = one.select(key, F.col("value").alias("a")).join(other.select(key, F.col("value").alias("b")), key)
    near = F.abs(F.col("a") - F.col("b")) <= tolerance * F.greatest("a", "b")
    mean = F.when(F.avg("b") != 0, (F.avg("a") - F.avg("b")) / F.avg("b") * 100).otherwise(0.0)
    return both.agg(F.count("*").alias("pairs"), F.count_if(~near & (F.col("a") < F.col("b"))).alias("first"), F.count_if(~near & (F.col("a") > F.col("b"))).alias("second"), F.count_if(near).alias("ties"), mean.alias("difference"))


def cursor(sort: Column, ident: Column) -> Column:
    """Where a page ends, as base64 of JSON."""
    return F.base64(F.to_json(F.struct(sort.alias("s"), ident.alias("i"))).cast("binary"))


def decoded(text: Column, schema: str) -> Column:
    """struct(s, i) of a cursor; null for one that is none."""
    return F.from_json(F.try_to_binary(text, F.lit("base64")).cast("string"), schema)
