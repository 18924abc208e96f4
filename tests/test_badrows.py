import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from filigree.operators.badrows import BLANK, _real_days, diagnose, isolated, load_index_lines, order_of, unquote

TYPES = frozenset({"10-K", "8-K"})
LINES = "line_id bigint, index_file string, layout string, year int, qtr int, line_no bigint, line string"


def lines(spark, bodies, layout="pipe", file="f", start=1):
    header = "CIK|Company Name|Form Type|Date Filed|Filename" if layout == "pipe" else "Form Type   Company Name   CIK   Date Filed  File Name"
    text = ["a", "b", "c", "d", "e", "", header, "-----", *bodies]
    rows = [(start + i, file, layout, 1995, 1, i + 1, t) for i, t in enumerate(text)]
    return spark.createDataFrame(rows, LINES)


def types(spark):
    return spark.createDataFrame([("10-K",), ("8-K",), (None,)], "form_type string")


def test_unquote():
    assert unquote('1|"a | b"|c') == ["1", "a | b", "c"]
    assert unquote('1| "say ""x""" |c') == ["1", 'say "x"', "c"]
    assert unquote('1|a "b" c|d') is None
    assert unquote('1|"a" b|d') is None
    assert unquote('1|"open|d') is None
    assert unquote("") == [""]


def test_reasons(spark):
    bodies = [
        '1|"A | B"|10-K|1995-01-03|x.txt',
        "1|A|10-K|1995-01-03",
        '1|A "B|10-K|1995-01-03|x.txt',
        "1|A|10-k|1995-01-03|x.txt",
        "1|123|10-K|1995-01-03|x.txt",
        "1|A\x02B|10-K|1995-01-03|x.txt",
        "1|A�B|10-K|1995-01-03|x.txt",
        "1|A|10-K|1995-02-30|x.txt",
        "1|A|10-K|95-02-03|x.txt",
        "   \r",
        " z|A  B|8-K|2000-02-29|y.txt \r",
        None,
    ]
    got = {r.line_id - 8: r for r in load_index_lines(lines(spark, bodies), types(spark)).collect()}
    assert {k: r.reason for k, r in got.items()} == {1: None, 2: "columns", 3: "quoting", 4: "form_type", 5: "company_name", 6: "company_name", 7: "company_name", 8: "date_filed", 9: "date_filed", 11: None}
    assert got[1].company_name == "A | B" and got[1].cik == 1
    assert got[11].company_name == "A B" and got[11].cik is None and got[11].date_filed == datetime.date(2000, 2, 29)


def test_fixed_layout_joins_surplus_pieces(spark):
    bodies = ["10-K      QUIET HARBOR CO  /TX/     700412   2003-11-05  edgar/data/700412/x.txt    ", "10-K   A B 5  2003-11-05  f"]
    got = load_index_lines(lines(spark, bodies, "fixed"), types(spark)).orderBy("line_id").collect()
    assert [r.reason for r in got] == [None, "columns"]
    assert got[0].company_name == "QUIET HARBOR CO /TX/" and got[0].url.endswith("edgar/data/700412/x.txt")


def test_every_block_size_agrees_with_strict_parsing(spark):
    bodies = [f"{i}|N{'a' if i % 3 else ''}|{'10-K' if i % 5 else '10K'}|19{90 + i % 9}-0{1 + i % 9}-{10 + i % 22}|f{'|g' if i % 7 == 0 else ''}" for i in range(200)]
    want = {i + 9: diagnose(b, "pipe", order_of(None, "pipe"), TYPES)[0] for i, b in enumerate(bodies)}
    for block in (1, 7, 1024):
        got = {r.line_id: r.reason for r in load_index_lines(lines(spark, bodies), types(spark), block=block).collect()}
        assert got == want
    assert BLANK.strip(" \t\r\n") == ""


def test_clashing_columns_copies_and_empty_tables(spark):
    df = lines(spark, ["1|A|10-K|1995-01-03|x", "1|A|10-K|1995-01-03|x"]).withColumns({"reason": F.lit("r"), "header": F.lit(1), "_from": F.lit(2)})
    assert [r.reason for r in load_index_lines(df, types(spark)).collect()] == [None, None]
    assert load_index_lines(df.limit(0), types(spark)).count() == 0
    assert load_index_lines(df.where("line_no < 7"), types(spark)).count() == 0
    got = load_index_lines(df, types(spark).limit(0)).collect()
    assert {r.reason for r in got} == {"form_type"}


def test_bisection_isolates_what_is_not_taken():
    taken = np.array([True, False, True, True, False, False, True])
    assert isolated(taken) == [1, 4, 5] and isolated(taken[2:4]) == [] and isolated(taken[:0]) == []


def test_real_days():
    days = ["2000-02-29", "1900-02-29", "2004-02-29", "2003-02-29", "1999-04-31", "1999-12-31", "0000-01-01", "0001-01-01", "1999-13-01", "1999-00-10", "1999-1-01", "", None, "1999-01-01\n"]

    def real(text):
        try:
            return text is not None and len(text) == 10 and bool(datetime.date.fromisoformat(text))
        except ValueError:
            return False

    assert _real_days(pa.array(days, pa.string())).tolist() == [real(d) for d in days]
