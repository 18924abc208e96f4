"""Parsing and cleaning of filing texts as column expressions.

All are native expressions, evaluated in the JVM. Patterns follow the semantics of
the source system: white space is Unicode's and the four separators below a space,
a dot stops only at a line feed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
# Closing tags that end a paragraph, in either case.
PARAGRAPH_TAGS = ("p", "div", "tr", "h1", "h2", "h3", "h4", "h5", "title")
# The ten patterns of the section search, misspelling included.
SEARCH_PATTERNS = (
    "tsunami",
    "deepwater.horizon",
    "climate.change|global.warming",
    "collaps|housing.market|recession|subprim|collateral",
    "ebola|influenza|zika",
    "tarrif",
    "obama",
    "hack|cyber",
    "crimea",
    "brexit",
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{WS}+|{WS}+$", "")


def is_html(c: Column) -> Column:
    """Whether one of three closing tags stands in a text, all lower or all upper case."""
    return c.rlike("</(p|div|td|P|DIV|TD)>")


def html_paragraphs(c: Column, unescape=None) -> Column:
    """HTML text -> array of paragraphs. Line ends are spaces, known closing tags part paragraphs, other tags go.

    Bodies of scripts and styles stay, as do tags of mixed case as parting marks.
    unescape resolves character references (a function of a column), as a last step.
    """
    tags = "|".join([*PARAGRAPH_TAGS, *(t.upper() for t in PARAGRAPH_TAGS)])
    flat = F.translate(c, "\n\r", "  ")
    marked = F.regexp_replace(flat, f"</(?:{tags})>", "\u0001")
    plain = F.regexp_replace(marked, "<[^>]*>", "")
    return F.split(unescape(plain) if unescape else plain, "\u0001")


def has_carriage_return(c: Column) -> Column:
    """Whether a carriage return is left after those of line ends are gone: plain text then cannot be split."""
    return F.contains(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"))


def plain_paragraphs(c: Column) -> Column:
    """Plain text -> array of paragraphs: page marks and rules go, blank lines part, word wrap is undone."""
    x = c
    for tag in ("PAGE", "C", "S", "CAPTION"):
        x = F.regexp_replace(x, f"(?d)<{tag}>.*", "\n")
    x = F.regexp_replace(x, "(?d)<TABLE>.*?</TABLE>", "")
    x = F.regexp_replace(x, f"(?Ud)^{WS}*PAGE.*$", "\n")
    x = F.regexp_replace(x, "-{2,}", "")
    x = F.replace(x, F.lit("_"), F.lit(" "))
    x = F.replace(x, F.lit("\r\n"), F.lit("\n"))
    x = F.regexp_replace(x, f"(?U)\n{WS}*\n", "<br />")
    x = F.replace(x, F.lit("-\n"), F.lit(""))
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    return F.split(x, "<br />")


def clean_paragraph(c: Column) -> Column:
    """One paragraph with plain quotes and spaces, bullets and repeated spaces gone."""
    x = F.translate(c, " ”’\t", " \"' ")
    x = F.regexp_replace(x, f"(?U){WS}+[●·•\\x95]{WS}+", " ")
    x = F.regexp_replace(x, " {2,}", " ")
    return strip(x)


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def is_text_line(c: Column) -> Column:
    """More than three letters a-z, and not just the heading of a table of contents."""
    letters = F.lower(F.regexp_replace(c, "[^a-zA-Z]+", ""))
    return (F.length(letters) > 3) & ~(F.contains(letters, F.lit("tableofcontents")) & (F.length(letters) <= 19))


def is_paragraph(c: Column) -> Column:
    """More than a hundred letters of any script."""
    return F.length(F.regexp_replace(c, r"\P{L}", "")) > 100


def long_lines(c: Column) -> Column:
    """Lines of more than fifty characters."""
    return F.filter(F.split(c, "\n"), lambda p: F.length(p) > 50)


def clean_paragraphs(paragraphs: Column) -> Column:
    """Cleaned paragraphs that are text."""
    return F.filter(F.transform(paragraphs, clean_paragraph), is_text_line)


def all_ascii(paragraphs: Column) -> Column:
    """Whether every cleaned paragraph is ASCII; one that is not fails its whole document."""
    return F.forall(F.transform(paragraphs, clean_paragraph), is_ascii)


def _places(paragraphs: Column, test) -> Column:
    """0-based positions of paragraphs that pass a test."""
    at = F.transform(paragraphs, lambda p, i: F.when(F.coalesce(test(p), F.lit(False)), i))
    return F.filter(at, lambda i: i.isNotNull())


def _tail(paragraphs: Column, start: Column) -> Column:
    return F.slice(paragraphs, start + 1, F.greatest(F.size(paragraphs) - start, F.lit(0)))


def header_marks(paragraphs: Column) -> Column:
    return _places(paragraphs, lambda p: p.rlike(r"(?id)^part i\.?$"))


def remove_header(paragraphs: Column) -> Column:
    """What follows the last `Part I` heading, if there are up to two; null with more."""
    marks = header_marks(paragraphs)
    n = F.size(marks)
    return F.when(n == 0, paragraphs).when(n <= 2, _tail(paragraphs, F.try_element_at(marks, n.cast("int"))))


def section_marks(paragraphs: Column, early: Column) -> tuple[Column, Column]:
    """(starts, stops) of the risk section; early filings carry it under another item, matched at the start only."""

    def at(old: str, new: str) -> Column:
        return _places(paragraphs, lambda p: F.when(early, p.rlike(old)).otherwise(p.rlike(new)))

    starts = at(r"(?id)^item 7.? ?(management's discussion)?", r"(?id)^item 1a.? ?(risk factors.*)?$")
    stops = at(r"(?id)^item 8.? ?(financial statements)?", r"(?id)^item 2.? ?(properties.*)?$")
    return starts, stops


def section(paragraphs: Column, early: Column) -> Column:
    """Paragraphs between the one start and the one stop; empty if they are in the wrong order, null without exactly one each."""
    starts, stops = section_marks(paragraphs, early)
    s, e = F.try_element_at(starts, F.lit(1)), F.try_element_at(stops, F.lit(1))
    body = F.slice(paragraphs, s + 2, F.greatest(F.lit(0), e - s - 1))
    return F.when((F.size(starts) == 1) & (F.size(stops) == 1), body)


def section_summary(paragraphs: Column) -> Column:
    """struct<chars, paragraphs, excerpt>; -1 and null for a null section, null excerpt below two paragraphs."""
    chars = F.aggregate(paragraphs, F.lit(0).cast("bigint"), lambda a, p: a + F.length(p))
    ends = F.concat(F.left(F.try_element_at(paragraphs, F.lit(1)), F.lit(50)), F.lit(" ... "), F.right(F.try_element_at(paragraphs, F.lit(2)), F.lit(50)))
    return F.struct(F.coalesce(chars, F.lit(-1).cast("bigint")).alias("chars"), F.when(paragraphs.isNull(), -1).otherwise(F.size(paragraphs)).alias("paragraphs"), ends.alias("excerpt"))


def containing(c: Column, pattern: str) -> Column:
    """Whole lines that hold a pattern, without case. A hit takes its line ends, so of two such lines in a row only the first counts."""
    return F.regexp_extract_all(c, F.lit(f"(?i)\n([^\n]*({pattern})[^\n]*)\n"), F.lit(1))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "“", '"')


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z ]", "")


def between(c: Column, start: str, stop: str) -> Column:
    """What stands between two marks."""
    return F.split_part(F.split_part(c, F.lit(start), F.lit(2)), F.lit(stop), F.lit(1))


def unwrap(c: Column) -> Column:
    """Single line ends become spaces, blank lines single line ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\n\n", "\u0001"), "\n", " "), "\u0001", "\n")
