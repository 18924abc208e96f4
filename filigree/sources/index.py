"""Quarterly filing indexes: zip archives, header and body lines, validation, and the run of one form type."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree import result
from filigree.functions.collections import day, quarter_bounds
from filigree.functions.text import strip

# Fixed value: where the paths of an index lead.
ARCHIVES = "https://www.sec.gov/Archives/"
NAMES = ("Form Type", "Company Name", "CIK", "Date Filed", "Filename")


def read_zipped_lines(spark: SparkSession, path: str, member: str = "form.idx") -> DataFrame:
    """(path, line_no, line) of a member of every zip archive under a path; line_no from 1.

    zip is no codec of the readers, so archives come as whole files and are opened
    in a function; lines leave it in batches.
    """

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as lines:
                    text = io.TextIOWrapper(lines, "utf-8", errors="replace", newline="\n")
                    held: list[str] = []
                    start = 1
                    for line in text:
                        held.append(line.rstrip("\n"))
                        if len(held) == 50_000:
                            yield pd.DataFrame({"path": where, "line_no": range(start, start + len(held)), "line": held})
                            start += len(held)
                            held = []
                    if held:
                        yield pd.DataFrame({"path": where, "line_no": range(start, start + len(held)), "line": held})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unzip, "path string, line_no bigint, line string")


def split_line(line: Column) -> Column:
    """Fields of an index line: two or more spaces part like a bar; surplus fields join the second by a space."""
    fields = F.transform(F.split(F.regexp_replace(strip(line), " {2,}", "|"), "\\|"), strip)
    k = F.size(fields)
    more = F.concat(F.slice(fields, 1, 1), F.array(F.array_join(F.slice(fields, F.lit(2), k - 4), " ")), F.slice(fields, k - 2, F.lit(3)))
    return F.when(k > 5, more).otherwise(fields)


def headers(lines: DataFrame, file: str = "index_file") -> DataFrame:
    """(file, header, rule_no): column names of each file, and the place of its rule.

    The header is the first line that is not blank after five lines, the rule the
    first line of dashes alone. A file without them, or with other columns than the
    five, gives a null header.
    """
    text = lines.where((F.col("line_no") > 5) & (strip(F.col("line")) != ""))
    rule = F.when(strip(F.col("line")).rlike("^-+$"), F.col("line_no"))
    first = text.groupBy(F.col(file).alias("_file")).agg(F.min_by("line", "line_no").alias("_head"), F.min(rule).alias("rule_no"))
    names = F.transform(split_line(F.col("_head")), lambda n: F.when(n == "File Name", "Filename").otherwise(n))
    fine = F.size(F.array_except(F.array(*[F.lit(n) for n in NAMES]), names)) == 0
    return first.select("_file", F.when(fine & (F.size(names) == 5), names).alias("header"), "rule_no")


def parse_body(lines: DataFrame, file: str = "index_file", prefix: str = ARCHIVES) -> DataFrame:
    """Body lines as filings with an error column; lines with fewer than five fields, or values that are none, fail.

    lines: a file column, year, qtr, line_no, line and maybe more, which is kept.
    """
    heads = headers(lines, file)
    body = lines.join(heads, lines[file] == heads["_file"]).where((F.col("line_no") > F.col("rule_no")) & (strip(F.col("line")) != ""))
    body = body.withColumn("_fields", split_line(F.col("line")))
    few = F.when(F.size("_fields") < 5, result.error("index", "ParseError", F.concat(F.lit("too few elements: "), F.col("line"))))
    head = F.when(F.col("header").isNull(), result.error("index", "AssertionError", "unexpected columns"))
    row = F.when((F.size("_fields") == 5) & F.col("header").isNotNull(), F.map_from_arrays("header", "_fields"))
    body = body.withColumn("_row", row)
    cik, filed = F.expr("try_cast(_row['CIK'] as bigint)"), day(F.col("_row")["Date Filed"])
    bad = F.when(F.col("_row").isNotNull() & (cik.isNull() | filed.isNull()), result.error("index", "ValueError", F.coalesce(F.when(cik.isNull(), F.col("_row")["CIK"]), F.col("_row")["Date Filed"])))
    out = body.withColumns(
        {
            "form_type": F.col("_row")["Form Type"],
            "company_name": F.col("_row")["Company Name"],
            "cik": cik,
            "date_filed": filed,
            "url": F.concat(F.lit(prefix), F.col("_row")["Filename"]),
            "error": F.coalesce(head, few, bad),
        }
    )
    return out.drop("_file", "header", "rule_no", "_fields", "_row", "line")


def violations(filings: DataFrame, form_type: str | None = None) -> Column:
    """Names of the checks that a filing fails: form_type, cik, date_filed, url."""
    low, high = quarter_bounds(F.col("year"), F.col("qtr"))
    checks = [
        F.when(~(F.col("form_type") == form_type), "form_type") if form_type else F.lit(None).cast("string"),
        F.when(~((F.col("cik") > 1000) | (F.col("cik") == 20)), "cik"),
        F.when(~((F.col("date_filed") > low) & (F.col("date_filed") < high)), "date_filed"),
        F.when(~F.contains("url", F.col("cik").cast("string")), "url"),
    ]
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def first_run(rows: DataFrame, form_type: str, order: list, by: list[str]) -> DataFrame:
    """The first unbroken run of rows of a form type in an order, for each value of `by`.

    Later runs are lost, as in a scan that stops at the end of the first. by names
    the file, whose lines are ordered together.
    """
    if not by:
        raise ValueError("by: the columns that name a file")
    keys = [F.col(c) for c in by]
    every = Window.partitionBy(*keys).orderBy(*order)
    before = every.rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(F.col("form_type") == form_type, F.lit(False))
    marked = rows.withColumn("_hit", hit)
    marked = marked.withColumn("_started", F.max(F.col("_hit").cast("int")).over(before))
    marked = marked.withColumn("_ended", F.max(F.when((F.col("_started") == 1) & ~F.col("_hit"), 1).otherwise(0)).over(before))
    return marked.where("_hit and _ended = 0").drop("_hit", "_started", "_ended")


def url_part(year: Column, qtr: Column) -> Column:
    """Where the archive of a quarter's index lies."""
    return F.concat(F.lit(ARCHIVES + "edgar/full-index/"), year, F.lit("/QTR"), qtr, F.lit("/form.zip"))


def scan(lines: DataFrame, form_type: str, file: str = "index_file", prefix: str = ARCHIVES) -> DataFrame:
    """The first run of a form type in each index file, parsed, with the names of the checks that a filing fails in `violations`."""
    parsed = parse_body(lines, file, prefix).where("error is null").drop("error")
    return first_run(parsed, form_type, [F.col("line_no")], [file]).withColumn("violations", violations(parsed, form_type))


def year_range(filings: DataFrame, first: int, last: int, quarters: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Filings of the years from first to last; the source system's range stopped before the fourth quarter, as quarters=(1, 2, 3) does."""
    return filings.where(F.col("year").between(first, last) & F.col("qtr").isin(*quarters))
