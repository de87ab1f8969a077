"""What a validation and timing harness does with small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(df: DataFrame, column: str, q: float, name: str = "value") -> DataFrame:
    """Nearest rank, the lower of two middle values."""
    return df.selectExpr(f"percentile_disc({float(q)!r}) WITHIN GROUP (ORDER BY `{column}`) AS `{name}`")


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every implementation with every case; both are short literal lists."""
    return left.crossJoin(right)


def expected(cases: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each case with its result; a case without one keeps nulls."""
    return cases.join(results, key, "left")


def required(cases: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each case with its result; a case without one fails the job, and names the case."""
    found = cases.join(results.withColumn("_found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no result for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    # The key itself carries the test, so that no optimizer drops it.
    return found.withColumn(key, F.when(F.col("_found"), F.col(key)).otherwise(missing.cast(dict(cases.dtypes)[key]))).drop("_found")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with ``side``."""
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def rank_nulls_last(df: DataFrame, column: str) -> DataFrame:
    """Ascending, missing values last, with ``rank`` from 1 on; for a summary's few rows, which one task ranks."""
    order = F.col(column).asc_nulls_last()
    return df.withColumn("rank", F.row_number().over(Window.orderBy(order))).orderBy("rank")


def rotated(position: Column, shift: Column | int, size: int) -> Column:
    """Where an item stands after a rotation to the left."""
    return F.pmod(position - F.lit(shift), F.lit(size))


def sorted_list(values: Column, separator: str = ", ") -> Column:
    """Sorted and joined."""
    return F.array_join(F.array_sort(values), separator)
