"""Lists of terms in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, cnt, word_id) of CSV lines of a count and the words of a term; ids from 0 in order of the terms.

    Lines may have any number of words. Blank lines give nothing.
    """
    from filigree.operators.terms import ranks

    fields = F.split(F.trim("value"), ",")
    rows = spark.read.text(path).where(F.trim("value") != "")
    terms = rows.select(F.array_join(F.slice(fields, F.lit(2), F.size(fields)), " ").alias("term"), F.expr("try_cast(split(trim(value), ',')[0] as bigint)").alias("cnt"))
    return ranks(terms, [F.col("term")], "word_id").withColumn("word_id", F.col("word_id") - 1)
