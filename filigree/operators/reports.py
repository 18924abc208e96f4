"""Searches, timing reports and totals."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.text import SEARCH_PATTERNS, containing


def search(texts: DataFrame, key: list[str], text: str = "text", patterns: tuple[str, ...] = SEARCH_PATTERNS) -> DataFrame:
    """(key, pattern, match_no, line): lines that hold a pattern; records without a hit give no rows."""
    padded = F.concat(F.lit("\n"), F.col(text), F.lit("\n"))
    # one pass finds the texts with any pattern; whole lines are looked for only where the pattern stands at all
    texts = texts.where(F.col(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))
    hits = F.array(*[F.when(F.col(text).rlike(f"(?i){p}"), F.struct(F.lit(p).alias("pattern"), containing(padded, p).alias("lines"))) for p in patterns])
    found = texts.select(*key, F.explode(hits).alias("_h")).where(F.size("_h.lines") > 0)
    return found.select(*key, F.col("_h.pattern").alias("pattern"), F.posexplode("_h.lines").alias("match_no", "line"))


def search_report(hits: DataFrame, filings: DataFrame, key: str = "url") -> DataFrame:
    """(pattern, line): per hit a heading `company (CIK c) Yy-Qq` and its lines, as text."""
    head = F.format_string("%s (CIK %d) Y%d-Q%d", "company_name", "cik", "year", "qtr")
    both = hits.join(filings.select(key, head.alias("head")), key)
    return both.groupBy("pattern", "head").agg(F.array_join(F.array_sort(F.collect_list(F.struct("match_no", "line"))).getField("line"), "\n").alias("_l")).select("pattern", F.concat("head", F.lit("\n"), "_l").alias("line"))


def timing_report(samples: DataFrame, memory: str | None = None) -> DataFrame:
    """(path, n, mean, std, of_parent, of_second, percall, percall_std) of samples (path array<string>, duration).

    With the name of a column of memory used there are memory_mean and memory_std too.

    std is that of a sample, 0 for a single one; of_parent is the part of the
    parent's total time in percent, of_second that of the ancestor at depth two.
    """
    extra = [F.avg(memory).alias("memory_mean"), F.coalesce(F.stddev_samp(memory), F.lit(0.0)).alias("memory_std")] if memory else []
    each = samples.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("_sum"), F.avg("duration").alias("mean"), F.coalesce(F.stddev_samp("duration"), F.lit(0.0)).alias("std"), *extra)
    sums = each.select(F.col("path").alias("_p"), F.col("_sum").alias("_s"))
    parent = sums.select(F.col("_p").alias("_pp"), F.col("_s").alias("_ps"))
    second = sums.select(F.col("_p").alias("_dp"), F.col("_s").alias("_ds"))
    out = each.join(parent, F.col("_pp") == F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))), "left")
    out = out.join(second, F.col("_dp") == F.slice("path", 1, 2), "left")
    return out.select("path", "n", "mean", "std", (F.col("_sum") * 100 / F.col("_ps")).alias("of_parent"), (F.col("_sum") * 100 / F.col("_ds")).alias("of_second"), (F.col("mean") / F.col("n")).alias("percall"), (F.col("std") * F.col("n")).alias("percall_std"), *(["memory_mean", "memory_std"] if memory else []))


class Timer:
    """Nested timing on the driver, for threads each of its own; stages that raise are timed too."""

    def __init__(self) -> None:
        self.samples: list[tuple[list[str], float]] = []
        self._lock, self._own = threading.Lock(), threading.local()

    @contextmanager
    def stage(self, name: str):
        path = [*getattr(self._own, "path", []), name]
        self._own.path = path
        began = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            self._own.path = path[:-1]
            with self._lock:
                self.samples.append((path, took))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.samples, "path array<string>, duration double")
