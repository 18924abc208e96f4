"""Text functions by worked examples."""

from pyspark.sql import functions as F

from filigree.functions import collections as C
from filigree.functions import text as T
from filigree.operators import sections
from filigree.sources import sgml
from filigree.sources.decode import decode_bytes, unescape


def texts(spark, values, name="x"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, {name} string").orderBy("i")


def rows(df, column):
    return [r[0] for r in df.select(column).collect()]


#: Texts with the paragraphs they hold, written out by hand.
PLAIN = [
    ("", [""]),
    ("one line", ["one line"]),
    ("wrapped\nline", ["wrapped line"]),
    ("first\n\nsecond", ["first", "second"]),
    ("first\n \t\n\nsecond", ["first", "second"]),
    ("first\n\x1c\nsecond", ["first", "second"]),
    ("hyphen-\nated", ["hyphenated"]),
    ("a\r\nb\r\n\r\nc", ["a b", "c"]),
    ("over <PAGE> 3 gone\nunder", ["over ", "under"]),
    ("x<C>y\nz", ["x", "z"]),
    ("<S>1\n<CAPTION>2\nz", ["", "z"]),
    ("a <TABLE>1 2</TABLE> b", ["a  b"]),
    ("a <TABLE>1\n2</TABLE> b", ["a <TABLE>1 2</TABLE> b"]),
    ("PAGE 7", [" "]),
    ("  PAGE 7\n", ["", ""]),
    ("see PAGE 7", ["see PAGE 7"]),
    ("rule ---- here - there", ["rule  here - there"]),
    ("under_score", ["under score"]),
]


def test_plain_paragraphs(spark):
    got = rows(texts(spark, [t for t, _ in PLAIN]), T.plain_paragraphs(F.col("x")))
    for (text, want), found in zip(PLAIN, got):
        assert found == want, text


def test_carriage_returns(spark):
    assert rows(texts(spark, ["a\r\nb", "a\rb", "a\r\r\nb", ""]), T.has_carriage_return(F.col("x"))) == [False, True, True, False]


def test_between_and_unwrap(spark):
    df = texts(spark, ["head START body STOP tail", "no marks"])
    assert rows(df, T.between(F.col("x"), "START ", " STOP")) == ["body", ""]
    assert rows(texts(spark, ["a\nb\n\nc"]), T.unwrap(F.col("x"))) == ["a b\nc"]


def test_cleaning(spark):
    given = ["a\tb", "x y", "it’s ”so”", "  two   spaces ", "a \n • b", "9", "Table of Contents page", "(table of contents)", "Some text here"]
    want = ["a b", "x y", "it's \"so\"", "two spaces", "a b", "9", "Table of Contents page", "(table of contents)", "Some text here"]
    df = texts(spark, given)
    assert rows(df, T.clean_paragraph(F.col("x"))) == want
    assert rows(df, T.is_text_line(F.col("x"))) == [False, False, True, True, False, False, False, False, True]


def test_html(spark):
    html = '<html><head><title>Document</title></head>\n<body><div><span>\nHello\nworld.\n</span></div><P>A &amp; B</P><p>open</p >x</body>'
    got = texts(spark, [html]).select(T.html_paragraphs(F.col("x"), unescape)).first()[0]
    assert [g.strip() for g in got] == ["Document", "Hello world.", "A & B", "openx"]
    assert rows(texts(spark, ["<p>one </p>", "3 < 4 and 6 > 5", "</Td>"]), T.is_html(F.col("x"))) == [True, False, False]


def test_header_and_section(spark):
    cases = [["a", "b"], ["x", "Part I", "b"], ["PART I.", "x", "part i", "b"], ["Part I"] * 3, []]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, p array<string>").orderBy("i")
    assert rows(df, T.remove_header(F.col("p"))) == [["a", "b"], ["Part I", "b"], ["part i", "b"], None, []]
    cases = [
        (["Item 1A. Risk Factors", "this is data", "Item 2. Properties"], False, ["this is data"]),
        (["item 1a", "this is data", "Item 2"], False, ["this is data"]),
        (["Item 2", "x", "Item 1A"], False, []),
        (["Item 1A", "Item 1A", "x", "Item 2"], False, None),
        (["Item 7. Management's Discussion", "this is data", "see item 7 here", "Item 8. Financial Statements"], True, ["this is data", "see item 7 here"]),
        ([], True, None),
    ]
    df = spark.createDataFrame([(i, p, e) for i, (p, e, _) in enumerate(cases)], "i int, p array<string>, e boolean").orderBy("i")
    assert rows(df, T.section(F.col("p"), F.col("e"))) == [c[2] for c in cases]


def test_summary_of_short_and_missing_sections(spark):
    df = spark.createDataFrame([(0, ["one", "two"]), (1, ["one"]), (2, None), (3, [])], "i int, p array<string>").orderBy("i")
    assert [tuple(r[0]) for r in df.select(T.section_summary(F.col("p"))).collect()] == [(6, 2, "one ... two"), (3, 1, None), (-1, -1, None), (0, 0, None)]


def test_search_takes_the_first_of_neighbouring_lines(spark):
    df = texts(spark, ["\nA hack\nan other hack\nx\na CYBER thing\n", "hack", None])
    assert rows(df, T.containing(F.col("x"), "hack|cyber")) == [["A hack", "a CYBER thing"], [], None]


def test_errors_flow(spark):
    df = spark.createDataFrame([(1, "Some text here"), (2, "bad\rtext"), (3, "plain é text"), (4, None)], "i int, text string")
    got = {r.i: r for r in sections.paragraphs(df).collect()}
    assert got[1].paragraphs == ["Some text here"] and got[1].error is None
    assert got[2].error.type == "ValueError" and got[2].paragraphs is None
    assert got[3].error.type == "AssertionError"
    assert got[4].paragraphs is None


def test_submission(spark):
    one = "<DOCUMENT>\n<TYPE>not 4\n<TEXT>\nattachment\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>4\n<SEQUENCE>2\n<TEXT>\nthe doc\n</TEXT>\n</DOCUMENT>"
    untyped = "<DOCUMENT><TEXT>a</TEXT></DOCUMENT>" + one
    twice = "<DOCUMENT>\n<TYPE>4\n<TEXT>first\n<TEXT>second</TEXT>\n</DOCUMENT>"
    df = texts(spark, [one, untyped, "", twice])
    text, failed = sgml.main_document(sgml.documents(F.col("x")), F.lit("4"))
    got = df.select(text.alias("t"), failed.alias("e")).collect()
    assert got[0].t == "\nthe doc\n" and got[0].e is None
    assert got[1].e.type == "KeyError" and got[2].e.type == "ParseError"
    assert got[3].t == "first"


def test_decoding(spark):
    raw = [b'<meta charset="windows-1252">\x93', "é".encode(), b"\x93", b'charset="nothing"', b'charset="utf-8" \xff', None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "raw binary").select(decode_bytes(F.col("raw"))).collect()]
    assert got[0].text.endswith("“") and got[1].text == "é" and got[2].text == "“"
    assert got[3].failure and got[4].failure and got[3].text is None
    assert got[5].text is None and got[5].failure is None


def test_collections(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], {"x": 1}, {"x": 2, "y": 3})], "w array<string>, m map<string,int>, n map<string,int>")
    row = df.select(C.chunks(F.col("w"), 3).alias("c"), C.ngrams(F.col("w"), 2).alias("g"), C.ngrams(F.col("w"), 5).alias("e"), C.merge_maps(F.col("m"), F.col("n")).alias("m"), C.invert(F.col("n")).alias("i")).first()
    assert row.c == [["a", "b", "c"], ["d"]] and row.g == ["a b", "b c", "c d"] and row.e == []
    assert row.m == {"x": 2, "y": 3} and row.i == {2: "x", 3: "y"}
    sizes = spark.createDataFrame([(0,), (5,), (1024,), (1536,), (1 << 50,)], "b bigint").select(C.human_bytes(F.col("b")))
    assert [r[0] for r in sizes.collect()] == ["0 b", "5 b", "1 Kb", "2 Kb", "1024 Tb"]
