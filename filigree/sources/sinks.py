"""Reports written to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_phrase_counts(counts: DataFrame, path: str) -> None:
    """CSV of count and words by falling count, ties by term, for each n in a folder `n=...`."""
    line = F.concat_ws(",", F.col("cnt").cast("string"), F.replace("term", F.lit(" "), F.lit(",")))
    ordered = counts.repartitionByRange("n", F.desc("cnt"), "term").sortWithinPartitions("n", F.desc("cnt"), "term")
    ordered.select("n", line.alias("value")).write.mode("overwrite").partitionBy("n").text(path)


def write_stem_report(report: DataFrame, path: str) -> None:
    report.orderBy("stem").write.mode("overwrite").csv(path)


def write_by_quarter(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("year", "qtr").csv(path)


def write_search(report: DataFrame, path: str) -> None:
    """One folder of text files for each pattern."""
    report.select("pattern", F.col("line").alias("value")).write.mode("overwrite").partitionBy("pattern").text(path)


def write_table(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)
