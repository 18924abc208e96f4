"""Loading index lines while setting aside those that fail, with the reason.

Method: blocks of lines are parsed on a fast columnar path (one compiled pattern
and typed casts over whole Arrow arrays), once each. A block with anything the fast
path does not accept fails and is bisected, recursively, on the running number of
its failures until single lines are left; those are diagnosed by a strict parser,
which is the only place that decides on a reason.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\r\n"
BLOCK = 4096
# The five column names, in the order of each layout.
FIXED_ORDER = ("form_type", "company_name", "cik", "date_filed", "filename")
PIPE_ORDER = ("cik", "company_name", "form_type", "date_filed", "filename")
HEADINGS = {
    "Form Type": "form_type",
    "Company Name": "company_name",
    "CIK": "cik",
    "Date Filed": "date_filed",
    "Filename": "filename",
    "File Name": "filename",
}
REASONS = ("quoting", "columns", "form_type", "company_name", "date_filed")

_PIECE = r"[^ ]+(?: [^ ]+)*"
_FIXED = rf"^[ \t\r\n]*(?P<a>{_PIECE}) {{2,}}(?P<b>[^ ](?:.*[^ ])?) {{2,}}(?P<c>{_PIECE}) {{2,}}(?P<d>{_PIECE}) {{2,}}(?P<e>{_PIECE})$"
_PIPE = r'^(?P<a>[^|"]*)\|(?P<b>[^|"]*)\|(?P<c>[^|"]*)\|(?P<d>[^|"]*)\|(?P<e>[^|"]*)$'
_BAD_NAME = r"[\x00-\x1f\x7f-\x{9f}\x{FFFD}]"
_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def unquote(line: str) -> list[str] | None:
    """The fields of a pipe line, or None if a double quote is used wrongly."""
    fields, at, end = [], 0, len(line)
    while True:
        while at < end and line[at] in BLANK:
            at += 1
        if at < end and line[at] == '"':
            text, at = [], at + 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    return None
                text.append(line[at:close])
                if line[close + 1 : close + 2] == '"':
                    text.append('"')
                    at = close + 2
                    continue
                at = close + 1
                break
            bar = line.find("|", at)
            stop = end if bar < 0 else bar
            if line[at:stop].strip(BLANK):
                return None
            fields.append("".join(text).strip(BLANK))
        else:
            bar = line.find("|", at)
            stop = end if bar < 0 else bar
            if '"' in line[at:stop]:
                return None
            fields.append(line[at:stop].strip(BLANK))
        if bar < 0:
            return fields
        at = bar + 1


def diagnose(line: str, layout: str, order: tuple[str, ...], known: frozenset[str]) -> tuple[str | None, dict]:
    """(reason or None, fields) of one line, strictly."""
    line = line.strip(BLANK)
    if layout == "pipe":
        fields = unquote(line)
        if fields is None:
            return "quoting", {}
    else:
        fields = [x.strip(BLANK) for x in re.split(r" {2,}", line)]
        if len(fields) > 5:
            extra = len(fields) - 4
            fields = [fields[0], " ".join(fields[1 : 1 + extra]), *fields[1 + extra :]]
    if len(fields) != 5:
        return "columns", {}
    row = dict(zip(order, fields))
    if row["form_type"] not in known:
        return "form_type", row
    name = row["company_name"]
    if not any(c.isalpha() for c in name) or any(unicodedata.category(c) == "Cc" or c == "�" for c in name):
        return "company_name", row
    try:
        if not _DAY.fullmatch(row["date_filed"]):
            raise ValueError
        datetime.date.fromisoformat(row["date_filed"])
    except ValueError:
        return "date_filed", row
    return None, row


def _real_days(days: pa.Array) -> np.ndarray:
    """Whether each text is a day that the calendar has, as YYYY-MM-DD."""
    shaped = pc.fill_null(pc.match_substring_regex(days, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), False)
    whole = pc.if_else(shaped, days, "0000-00-00")
    year, month, day = (pc.cast(pc.utf8_slice_codeunits(whole, a, b), pa.int32()).to_numpy(zero_copy_only=False) for a, b in ((0, 4), (5, 7), (8, 10)))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(month, 0, 12)] + ((month == 2) & leap)
    return shaped.to_numpy(zero_copy_only=False) & (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= last)


def _fast(lines: pa.Array, layout: str, order: tuple[str, ...], known: pa.Array) -> tuple[dict[str, pa.Array], np.ndarray]:
    """(columns, which lines the fast path takes) of a block."""
    got = pc.extract_regex(pc.utf8_trim(lines, BLANK), _PIPE if layout == "pipe" else _FIXED)
    row = {name: pc.utf8_trim(pc.struct_field(got, i), BLANK) for i, name in enumerate(order)}
    name = row["company_name"]
    fine = pc.and_(pc.and_(got.is_valid(), pc.is_in(row["form_type"], known)), pc.and_(pc.match_substring_regex(name, r"\pL"), pc.invert(pc.match_substring_regex(name, _BAD_NAME))))
    taken = pc.fill_null(fine, False).to_numpy(zero_copy_only=False) & _real_days(row["date_filed"])
    return row, taken


def isolated(taken: np.ndarray) -> list[int]:
    """Places of the lines not taken, by recursive bisection: a part without a failure is left as a whole."""
    failures = np.concatenate([[0], np.cumsum(~taken)])
    found, todo = [], [(0, len(taken))]
    while todo:
        start, end = todo.pop()
        if failures[start] == failures[end]:
            continue
        if end - start == 1:
            found.append(start)
            continue
        middle = (start + end) // 2
        todo += [(middle, end), (start, middle)]
    return found


def _block(lines: pa.Array, layout: str, order: tuple[str, ...], known: pa.Array, names: frozenset[str]) -> Iterator[tuple[pa.Array, dict[str, pa.Array]]]:
    """(places, columns) of a block: of the lines that the fast path takes, and of the others, which carry a reason if they are not valid."""
    row, taken = _fast(lines, layout, order, known)
    bad = isolated(taken)
    good = pa.array(np.flatnonzero(taken))
    if len(good):
        columns = {k: v.take(good) for k, v in row.items()}
        columns["date_filed"] = pc.cast(columns["date_filed"], pa.date32())
        yield good, columns
    if bad:
        told = [diagnose(line, layout, order, names) for line in lines.take(pa.array(bad)).to_pylist()]
        columns = {k: pa.array([fields.get(k) for _, fields in told], pa.string()) for k in FIXED_ORDER if k != "date_filed"}
        columns["date_filed"] = pa.array([datetime.date.fromisoformat(fields["date_filed"]) if reason is None else None for reason, fields in told], pa.date32())
        yield pa.array(bad), columns | {"reason": pa.array([reason for reason, _ in told], pa.string())}


def order_of(header: str | None, layout: str) -> tuple[str, ...]:
    """Field order by a header line; that of the layout if there is no good header."""
    default = PIPE_ORDER if layout == "pipe" else FIXED_ORDER
    if not header:
        return default
    parts = [x.strip() for x in (header.split("|") if layout == "pipe" else re.split(r" {2,}", header.strip()))]
    found = tuple(HEADINGS.get(x, "") for x in parts)
    return found if set(found) == set(default) and len(found) == 5 else default


_OUT = pa.schema([("form_type", pa.string()), ("company_name", pa.string()), ("cik_text", pa.string()), ("date_filed", pa.date32()), ("filename", pa.string()), ("reason", pa.string())])


def _parse(names: frozenset[str], keys: tuple[str, ...], block: int):
    known = pa.array(sorted(names), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.table([batch["layout"], batch["header"]], names=["l", "h"]).group_by(["l", "h"]).aggregate([]).to_pylist()
            for kind in kinds:
                same = lambda col, x: pc.is_null(col) if x is None else pc.fill_null(pc.equal(col, x), False)
                mine = batch.filter(pc.and_(same(batch["layout"], kind["l"]), same(batch["header"], kind["h"])))
                layout = "pipe" if kind["l"] == "pipe" else "fixed"
                order = order_of(kind["h"], layout)
                lines = mine["line"]
                for start in range(0, len(lines), block):
                    piece = mine.slice(start, block)
                    for places, row in _block(lines.slice(start, block), layout, order, known, names):
                        part = piece.take(places)
                        out = [part[k] for k in keys] + [row["form_type"], row["company_name"], row["cik"], row["date_filed"], row["filename"], row.get("reason", pa.nulls(len(places), pa.string()))]
                        yield pa.RecordBatch.from_arrays(out, names=[*keys, *_OUT.names])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for part in run(batches):
            held.append(part)
            rows += part.num_rows
            if rows >= 8192:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged


def _is_dashes(line: Column) -> Column:
    return F.coalesce(line.rlike(r"^[ \t\r\n]*-+[ \t\r\n]*$"), F.lit(False))


def load_index_lines(lines: DataFrame, form_types: DataFrame, url_prefix: str = "https://filings.example/Archives/", block: int = BLOCK) -> DataFrame:
    """Body lines of quarterly index files as filings, or with the reason why not.

    lines: line_id, index_file, layout, year, qtr, line_no, line; other columns are
    ignored, whatever their names. form_types: form_type, the known types.

    Gives one row per non-blank body line (after the first line of dashes of its
    file): line_id, index_file, year, qtr, line_no, form_type, company_name, cik,
    date_filed, url and reason, which is null for valid lines and else the first
    of `quoting`, `columns`, `form_type`, `company_name`, `date_filed` that
    applies. Runs of spaces in a company name become one. Null and blank lines, and files without a line of dashes, give no
    rows. A null layout counts as fixed. Lines that stand twice give two rows. An
    empty table gives an empty result. A cik that is no number is null.

    The header and the place of the dashes are one row per file, so the join
    brings no group of lines into one task: a file with a large part of all lines
    is split by adaptive skew handling.
    """
    keys = ("line_id", "index_file", "year", "qtr", "line_no")
    base = lines.select(*keys, "layout", "line")
    heads = base.where(base.line.isNotNull()).groupBy("index_file").agg(
        F.min(F.when(_is_dashes(F.col("line")), F.col("line_no"))).alias("_from"),
        F.min_by("line", F.when(F.col("line").contains("CIK") & F.col("line").contains("Company Name"), F.col("line_no"))).alias("header"),
    )
    heads = heads.where("_from is not null").withColumnRenamed("index_file", "_file")
    body = base.join(heads, base.index_file.eqNullSafe(heads._file) & (base.line_no > heads._from))
    body = body.where(F.length(F.regexp_replace("line", r"[ \t\r\n]+", "")) > 0).select(*keys, "layout", "line", F.rtrim("header").alias("header"))
    # The known form types are a small fixed list; a longer one is refused, not cut.
    known = [r[0] for r in form_types.select("form_type").where("form_type is not null").distinct().limit(10_001).collect()]
    if len(known) > 10_000:
        raise ValueError("more than 10,000 known form types: this is no list of types")
    fields = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", form_type string, company_name string, cik_text string, date_filed date, filename string, reason string"
    done = body.mapInArrow(_parse(frozenset(known), keys, block), schema)
    valid = F.col("reason").isNull()
    return done.select(
        *keys,
        "form_type",
        F.regexp_replace("company_name", " {2,}", " ").alias("company_name"),
        F.expr("try_cast(cik_text as bigint)").alias("cik"),
        "date_filed",
        F.when(valid, F.concat(F.lit(url_prefix), "filename")).alias("url"),
        "reason",
    )
