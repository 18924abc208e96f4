"""Errors as data: a stage's failure becomes a column and flows on; it never ends a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "struct<stage:string,type:string,message:string>"


def no_error() -> Column:
    return F.lit(None).cast(ERROR)


def error(stage: str, kind: str, message: Column | str) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("type"), text.cast("string").alias("message")).cast(ERROR)


def lift(df: DataFrame, column: str, value: Column, failed: Column, into: str = "error") -> DataFrame:
    """Set column to value where no error is there yet and failed is null; else keep the first error."""
    earlier = F.col(into) if into in df.columns else no_error()
    now = F.coalesce(earlier, failed)
    return df.withColumns({column: F.when(now.isNull(), value), into: now})


def good(df: DataFrame) -> DataFrame:
    """Only the rows without an error."""
    return df.where("error is null")


def once(df: DataFrame, column: str, value: Column) -> DataFrame:
    """df with a column that is computed once per row, however often later expressions use it.

    Projections are merged by the optimiser and would repeat a costly expression
    for each use; a generator of exactly one row is not merged.
    """
    return df.select(*[c for c in df.columns if c != column], F.explode(F.array(value)).alias(column))
