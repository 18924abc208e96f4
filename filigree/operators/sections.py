"""From raw forms to sections: the stages of the pipeline, each with its errors as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree import result
from filigree.functions import text as T
from filigree.sources import sgml
from filigree.sources.decode import decode_bytes, unescape


def decoded(forms: DataFrame, raw: str = "raw") -> DataFrame:
    """forms with `text` in place of raw bytes; bytes that cannot be decoded fail."""
    df = forms.withColumn("_decoded", decode_bytes(F.col(raw)))
    failed = F.when(F.col("_decoded.failure").isNotNull(), result.error("decode", "UnicodeDecodeError", F.col("_decoded.failure")))
    return result.lift(df, "text", F.col("_decoded.text"), failed).drop("_decoded", raw)


def paragraphs(forms: DataFrame, text: str = "text", main: Column | None = None, resolve: bool = True) -> DataFrame:
    """forms with `paragraphs`: of HTML or plain text, cleaned; the header goes where main holds (annual reports).

    A carriage return within plain text, a paragraph that is not ASCII after
    cleaning, and more than two `Part I` headings fail the whole document.
    """
    c = F.col(text)
    html = T.is_html(c)
    failed = F.when(~html & T.has_carriage_return(c), result.error("paragraphs", "ValueError", "carriage return"))
    raw = F.when(html, T.html_paragraphs(c, unescape if resolve else None)).otherwise(T.plain_paragraphs(c))
    df = result.lift(forms, "_raw", raw, failed)
    df = result.once(df, "_raw", F.transform("_raw", T.clean_paragraph))
    failed = F.when(F.col("_raw").isNotNull() & ~F.forall("_raw", T.is_ascii), result.error("paragraphs", "AssertionError", "not ASCII"))
    df = result.lift(df, "paragraphs", F.filter("_raw", T.is_text_line), failed).drop("_raw")
    if main is not None:
        many = F.when(main & (F.size(T.header_marks(F.col("paragraphs"))) > 2), result.error("paragraphs", "ParseError", "too many Part I"))
        df = result.lift(df, "paragraphs", F.when(main, T.remove_header(F.col("paragraphs"))).otherwise(F.col("paragraphs")), many)
    return df


def sections(df: DataFrame, early: Column) -> DataFrame:
    """df with `section`, the paragraphs of the risk section; not exactly one start and one stop is an error."""
    starts, stops = T.section_marks(F.col("paragraphs"), early)
    one = lambda marks, name: F.when(F.size(marks) != 1, result.error("section", "ParseError", F.concat(F.lit("got "), F.size(marks), F.lit(f" {name}"))))
    failed = F.when(F.col("paragraphs").isNotNull(), F.coalesce(one(starts, "starts"), one(stops, "stops")))
    return result.lift(df, "section", T.section(F.col("paragraphs"), early), failed)


def good_rate(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows, those without an error, and their part in percent."""
    good = F.sum(F.when(F.col("error").isNull(), 1).otherwise(0))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), good.alias("good"), F.round(good * 100 / F.count(F.lit(1)), 0).alias("percent"))


def ranked(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, rank, value): a group's values in ascending order, nulls first, ready to plot.

    Rows are placed by one sort over ranges of group and value; a group's first
    place is taken off, so no group is brought into one task.
    """
    from filigree.operators.terms import ranks

    placed = ranks(df.select(*by, value), [*[F.col(c).asc_nulls_first() for c in by], F.col(value).asc_nulls_first()], "_place")
    first = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_place").alias("_first"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(first, same).select(*by, (F.col("_place") - F.col("_first") + 1).alias("rank"), value)


def from_forms(filings: DataFrame, submissions: DataFrame, early: Column) -> DataFrame:
    """filings with `section` and `error`: the main document of each one's submission, its paragraphs without the header, and the section in them."""
    forms = sgml.raw_forms(filings, submissions)
    found = paragraphs(forms, text="form", main=F.lit(True))
    return sections(found, early)
