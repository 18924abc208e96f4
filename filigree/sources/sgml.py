"""Documents in submissions, and the main one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree import result
from filigree.functions.collections import merge_maps


def documents(text: Column) -> Column:
    """array<map<string,string>>: the attributes of each document with a TEXT part, which is under `text`.

    The last TEXT part counts; an earlier one is read as an attribute like any
    other and then wins. Names are lower case, the last of a name wins, contents
    are not trimmed. Documents without TEXT are left out.
    """
    inner = F.regexp_extract_all(text, F.lit("(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))
    # what the last opening tag with a closing tag after it leaves before and behind
    head = F.transform(inner, lambda d: F.struct(d.alias("d"), F.substring_index(d, "</TEXT>", -1).alias("tail")))
    whole = F.filter(head, lambda h: F.length(h["tail"]) < F.length(h["d"]))
    cut = F.transform(whole, lambda h: F.struct(h["tail"].alias("tail"), F.left(h["d"], F.length(h["d"]) - F.length(h["tail"]) - 7).alias("h")))
    last = F.transform(cut, lambda c: F.struct(c["h"].alias("h"), F.substring_index(c["h"], "<TEXT>", -1).alias("after"), c["tail"].alias("tail")))
    last = F.filter(last, lambda c: F.length(c["after"]) < F.length(c["h"]))

    def parts(c: Column) -> Column:
        body = F.substring_index(c["after"], "</TEXT>", 1)
        rest = F.concat(F.left(c["h"], F.length(c["h"]) - F.length(c["after"]) - 6), F.substr(F.concat(c["after"], F.lit("</TEXT>"), c["tail"]), F.length(body) + 8))
        return F.struct(body.alias("text"), rest.alias("rest"))

    def attributes(p: Column) -> Column:
        tag = F.lit(r"(?s)<(.*?)>(.*?)[\n<]")
        names, values = F.regexp_extract_all(p["rest"], tag, F.lit(1)), F.regexp_extract_all(p["rest"], tag, F.lit(2))
        pairs = F.arrays_zip(F.transform(names, F.lower).alias("k"), values.alias("v"))
        first = F.create_map(F.lit("text"), p["text"])
        return F.aggregate(pairs, first, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))

    return F.transform(F.transform(last, parts), attributes)


def main_document(docs: Column, form_type: Column) -> tuple[Column, Column]:
    """(text, error) of the first document of a type; one without a type before it, or none at all, is an error."""
    types = F.transform(docs, lambda d: F.try_element_at(d, F.lit("type")))
    at = F.array_position(types, form_type)
    untyped = F.array_position(F.transform(types, lambda t: t.isNull()), F.lit(True))
    early = (untyped > 0) & ((at == 0) | (untyped < at))
    failed = F.when(docs.isNull(), result.error("form", "ParseError", "no submission")).when(early, result.error("form", "KeyError", "type")).when(F.coalesce(at, F.lit(0)) == 0, result.error("form", "ParseError", F.concat(F.lit("Cannot find the form_type "), form_type)))
    found = F.try_element_at(F.try_element_at(docs, F.when(at > 0, at).cast("int")), F.lit("text"))
    return F.when(failed.isNull(), found), failed


def raw_forms(filings: DataFrame, submissions: DataFrame) -> DataFrame:
    """filings with `form` and `error`: the main document of each one's submission (url, submission)."""
    both = filings.join(submissions.select(F.col("url").alias("_url"), "submission"), F.col("url") == F.col("_url"), "left").drop("_url")
    both = result.once(both, "_docs", documents(F.col("submission")))
    text, failed = main_document(F.col("_docs"), F.col("form_type"))
    earlier = F.col("error") if "error" in filings.columns else result.no_error()
    return both.withColumns({"form": text, "_failed": failed}).withColumn("error", F.coalesce(earlier, F.col("_failed"))).withColumn("form", F.when(F.col("error").isNull(), F.col("form"))).drop("_docs", "_failed", "submission")
