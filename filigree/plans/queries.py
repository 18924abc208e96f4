"""Queries of the core over whole test tables, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree import result
from filigree.functions import collections as C
from filigree.functions import text as T
from filigree.operators import badrows, reports, sections, terms, topics
from filigree.sources import index, sgml
from filigree.sources.decode import unescape
from filigree.store import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


# ---- index lines

_PIPE_FIELD = r"""[ \t\r]*(?:"(?:[^"]|"")*"[ \t\r]*|[^"|]*)"""
_P5 = rf"""
with lines as (
    select *, trim(line, ' ' || chr(9) || chr(10) || chr(13)) as t from index_lines where line is not null
), heads as (
    select index_file, min(case when regexp_full_match(t, '-+') then line_no end) as rule_no,
           arg_min(t, line_no) filter (where contains(t, 'CIK') and contains(t, 'Company Name')) as header
    from lines group by 1
), body as (
    select l.*, header, regexp_full_match(t, '{_PIPE_FIELD}(\|{_PIPE_FIELD})*') as quoted
    from lines l join heads h on l.index_file = h.index_file and line_no > rule_no where t <> ''
), split as (
    select *, case when layout = 'pipe' then
        case when quoted then list_transform(regexp_extract_all(t || '|', '({_PIPE_FIELD})\|', 1), lambda f: trim(f, ' ' || chr(9) || chr(13))) end
        else string_split_regex(t, ' {{2,}}') end as raw
    from body
), fields as (
    select *, case when layout = 'pipe' then list_transform(raw, lambda f: case when f like '"%' then trim(replace(f[2:-2], '""', '"'), ' ' || chr(9)) else f end)
        when len(raw) > 5 then [raw[1], array_to_string(raw[2:len(raw) - 3], ' ')] || raw[len(raw) - 2:] else raw end as f
    from split
), named as (
    select *, case when layout = 'pipe' then 3 else 1 end as ft, case when layout = 'pipe' then 1 else 3 end as ci from fields
), judged as (
    select *, case when layout = 'pipe' and not quoted then 'quoting' when len(f) <> 5 then 'columns'
        when f[ft] not in (select form_type from form_types) then 'form_type'
        when not regexp_matches(f[2], '\pL') or regexp_matches(f[2], '[\x00-\x1f\x7f-\x{{9f}}\x{{FFFD}}]') then 'company_name'
        when not regexp_full_match(f[4], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or try_cast(f[4] as date) is null then 'date_filed' end as reason
    from named
)
"""


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    return badrows.load_index_lines(read(spark, folder, "index_lines"), read(spark, folder, "form_types"))


@query(_P5 + "select line_id, reason from judged where reason is not null")
def p5_found(spark, folder):
    return _loaded(spark, folder).where("reason is not null").select("line_id", "reason")


@query(
    _P5
    + """select line_id, index_file, year, qtr, line_no, f[ft] as form_type, regexp_replace(f[2], ' {2,}', ' ', 'g') as company_name,
    try_cast(f[ci] as bigint) as cik, cast(f[4] as date) as date_filed, 'https://filings.example/Archives/' || f[5] as url from judged where reason is null"""
)
def p5_loaded(spark, folder):
    return _loaded(spark, folder).where("reason is null").drop("reason")


_WS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\pZ]"
_INDEX = rf"""
with lines as (
    select *, regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g') as t from index_lines
), heads as (
    select index_file, arg_min(t, line_no) as head, min(case when regexp_full_match(t, '-+') then line_no end) as rule_no
    from lines where line_no > 5 and t <> '' group by 1
), body as (
    select l.line_id, list_transform(string_split(regexp_replace(t, ' {{2,}}', '|', 'g'), '|'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')) as e,
           list_transform(string_split(regexp_replace(head, ' {{2,}}', '|', 'g'), '|'), lambda x: case when trim(x) = 'File Name' then 'Filename' else trim(x) end) as h
    from lines l join heads using (index_file) where line_no > rule_no and t <> ''
), five as (
    select line_id, h, case when len(e) > 5 then [e[1], array_to_string(e[2:len(e) - 3], ' ')] || e[len(e) - 2:] else e end as e from body
), named as (
    select line_id, len(e) as k, case when len(e) = 5 then e[list_position(h, 'Form Type')] end as form_type, case when len(e) = 5 then e[list_position(h, 'Company Name')] end as company_name,
           case when len(e) = 5 then try_cast(e[list_position(h, 'CIK')] as bigint) end as cik,
           case when len(e) = 5 and regexp_full_match(e[list_position(h, 'Date Filed')], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(e[list_position(h, 'Date Filed')] as date) end as date_filed
    from five
)
"""


@query(_INDEX + "select *exclude(k), case when k < 5 then 'ParseError' when cik is null or date_filed is null then 'ValueError' end as error from named")
def index_parse(spark, folder):
    out = index.parse_body(read(spark, folder, "index_lines"))
    return out.select("line_id", "form_type", "company_name", "cik", "date_filed", F.col("error.type").alias("error"))


@query(
    """select url, line_no, array_to_string(list_filter([
    case when not (cik > 1000 or cik = 20) then 'cik' end,
    case when not (date_filed > make_date(year, 1, 1) + (qtr - 1) * 87 and date_filed < make_date(year, 1, 1) + cast(floor(qtr * 91.5) as int)) then 'date_filed' end,
    case when not contains(url, cast(cik as varchar)) then 'url' end], lambda x: x is not null), ',') as violations from filings"""
)
def index_violations(spark, folder):
    f = read(spark, folder, "filings")
    return f.select("url", "line_no", F.array_join(index.violations(f), ",").alias("violations"))


@query(
    """with o as (select *, row_number() over (partition by index_file order by line_no, loaded_at, url) as i from filings),
    s as (select *, i - row_number() over (partition by index_file, form_type order by i) as island from o where form_type = '10-Q'),
    f as (select index_file, min(island) as island from s group by 1)
    select index_file, line_no, url, loaded_at from s join f using (index_file, island)"""
)
def first_run_filter(spark, folder):
    f = read(spark, folder, "filings")
    return index.first_run(f, "10-Q", [F.col("line_no"), F.col("loaded_at"), F.col("url")], ["index_file"]).select("index_file", "line_no", "url", "loaded_at")


@query("select form_type, cik, url from filings where year <= 2000 union all select form_type, cik, url from filings where year > 2000")
def union_quarters(spark, folder):
    f = read(spark, folder, "filings").select("form_type", "cik", "url", "year")
    return f.where("year <= 2000").drop("year").unionByName(f.where("year > 2000").drop("year"))


@query("select url, year, qtr, line_no, loaded_at from filings where year between 1996 and 2004")
def index_year_range(spark, folder):
    return index.year_range(read(spark, folder, "filings"), 1996, 2004).select("url", "year", "qtr", "line_no", "loaded_at")


@query(
    _INDEX
    + """, good as (select l.line_id, l.index_file, l.line_no, n.form_type, cik, date_filed, year, qtr from named n join index_lines l using (line_id) where k >= 5 and cik is not null and date_filed is not null),
    o as (select *, row_number() over (partition by index_file order by line_no) as i from good),
    s as (select *, i - row_number() over (partition by index_file order by i) as island from o where form_type = '10-K'), f as (select index_file, min(island) as island from s group by 1),
    m as (select line_id, list_position(h, 'Filename') as file_at, e from five)
    select line_id, array_to_string(list_filter([case when not (cik > 1000 or cik = 20) then 'cik' end,
    case when not (date_filed > make_date(year, 1, 1) + (qtr - 1) * 87 and date_filed < make_date(year, 1, 1) + cast(floor(qtr * 91.5) as int)) then 'date_filed' end,
    case when not contains('https://www.sec.gov/Archives/' || e[file_at], cast(cik as varchar)) then 'url' end], lambda x: x is not null), ',') as violations from s join f using (index_file, island) join m using (line_id)"""
)
def index_scan(spark, folder):
    return index.scan(read(spark, folder, "index_lines"), "10-K").select("line_id", F.array_join("violations", ",").alias("violations"))


@query("select f.url, f.loaded_at, l.line_id from filings f join index_lines l on f.index_file = l.index_file and f.line_no = l.line_no")
def zip_by_key(spark, folder):
    lines = read(spark, folder, "index_lines").select("index_file", "line_no", "line_id")
    return C.zipped(read(spark, folder, "filings").select("index_file", "line_no", "url", "loaded_at"), lines, ["index_file", "line_no"]).select("url", "loaded_at", "line_id")


@query("select year, cik, para_no, para_id from para_stems")
def rekeyed(spark, folder):
    return read(spark, folder, "para_stems").select("year", "cik", "para_no", "para_id")


@query("select i as n, i * i as square from range(1000) t(i)")
def integer_range(spark, folder):
    return spark.range(0, 1000, 1, 4).select(F.col("id").alias("n"), (F.col("id") * F.col("id")).alias("square"))


@query("select * from (values (0, 'a'), (1, 'b'), (2, 'c')) t(n, item)")
def item_sequence(spark, folder):
    return spark.createDataFrame(list(enumerate("abc")), "n int, item string")


# ---- submissions

_SUBMISSION = """'<SEC-DOCUMENT>x' || chr(10) || '<DOCUMENT>' || chr(10) || '<TYPE>' || case when doc_id % 4 = 0 then 'EX-1' else coalesce(form_type, 'NONE') end || chr(10) || '<SEQUENCE>1' || chr(10)
    || '<TEXT>' || text || '</TEXT>' || chr(10) || '</DOCUMENT>' || case when doc_id % 3 = 0 then '' else '<DOCUMENT><TYPE>' || coalesce(form_type, 'NONE') || '</TYPE><FILENAME>b.txt' || chr(10) || '<TEXT>second ' || doc_id || '</TEXT></DOCUMENT>' end || '<DOCUMENT>no text</DOCUMENT>'"""


def _submissions(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", "form_type", F.expr(_SUBMISSION.replace("chr(10)", "'\\n'")).alias("submission"))


_DOCS = f"""with s as (select doc_id, form_type, {_SUBMISSION} as x from documents where text is not null),
    d as (select doc_id, form_type, unnest(regexp_extract_all(x, '(?s)<DOCUMENT>(.*?)</DOCUMENT>', 1)) as d, generate_subscripts(regexp_extract_all(x, '(?s)<DOCUMENT>(.*?)</DOCUMENT>', 1), 1) as k from s),
    t as (select doc_id, form_type, k, regexp_extract(d, '(?s)<TYPE>(.*?)[\\n<]', 1) as type, regexp_extract(d, '(?s)<TEXT>(.*?)</TEXT>', 1) as text from d where contains(d, '<TEXT>'))"""


@query(_DOCS + " select doc_id, count(*) as documents, sum(length(text)) as chars from t group by 1")
def sgml_documents(spark, folder):
    docs = _submissions(spark, folder).select("doc_id", F.explode(sgml.documents(F.col("submission"))).alias("d"))
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length(F.col("d")["text"])).alias("chars"))


@query(_DOCS + ", m as (select doc_id, arg_min(text, k) as form from t where type = form_type group by 1) select s.doc_id, m.form, case when m.form is null then 'ParseError' end as error from s left join m using (doc_id)")
def sgml_main_document(spark, folder):
    s = result.once(_submissions(spark, folder), "docs", sgml.documents(F.col("submission")))
    text, failed = sgml.main_document(F.col("docs"), F.col("form_type"))
    return s.select("doc_id", text.alias("form"), failed.getField("type").alias("error"))


# ---- paragraphs and sections

_HTML = """'<html><head><meta charset="utf-8"><title>T' || doc_id || '</title></head><body>' || chr(10) || '<p class="a">' || replace(text, chr(10), '</p>' || chr(10) || '<p>') || '</p><p>caf&eacute; &amp; 3 &lt; 4</p><DIV>end</DIV><span>tail</span></body></html>'"""


@query(
    f"""with h as (select doc_id, {_HTML} as x from documents where text is not null),
    p as (select doc_id, string_split(regexp_replace(regexp_replace(replace(replace(x, chr(10), ' '), chr(13), ' '), '</(?:p|div|tr|h1|h2|h3|h4|h5|title|P|DIV|TR|H1|H2|H3|H4|H5|TITLE)>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) as p from h)
    select doc_id, generate_subscripts(p, 1) - 1 as para_no, unnest(list_transform(p, lambda t: replace(replace(replace(t, '&eacute;', 'é'), '&lt;', '<'), '&amp;', '&'))) as text from p"""
)
def html_paragraphs(spark, folder):
    d = read(spark, folder, "documents").where("text is not null")
    raw = d.select("doc_id", F.encode(F.expr(_HTML.replace("chr(10)", "'\\n'")), "utf-8").alias("raw"))
    return sections.decoded(raw).select("doc_id", F.posexplode(T.html_paragraphs(F.col("text"), unescape)).alias("para_no", "text"))


_CLEAN = f"""
with a as (select doc_id, lang, source, replace(text, chr(13) || chr(10), chr(10)) as crlf, text from documents where text is not null and not regexp_matches(text, '</(p|div|td|P|DIV|TD)>')),
b as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<PAGE>[^\\n]*', chr(10), 'g'), '<C>[^\\n]*', chr(10), 'g'), '<S>[^\\n]*', chr(10), 'g'), '<CAPTION>[^\\n]*', chr(10), 'g') as x from a),
c as (select *, replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '<TABLE>[^\\n]*?</TABLE>', '', 'g'), '^{_WS}*PAGE[^\\n]*(\\n?)$', chr(10) || '\\1'), '-{{2,}}', '', 'g'), '_', ' '), chr(13) || chr(10), chr(10)) as y from b),
d as (select *, string_split(replace(replace(regexp_replace(y, '\\n{_WS}*\\n', '<br />', 'g'), '-' || chr(10), ''), chr(10), ' '), '<br />') as raw from c),
e as (select *, list_transform(raw, lambda p: regexp_replace(regexp_replace(regexp_replace(translate(p, chr(160) || '”’' || chr(9), ' "'' '), '{_WS}+[●·•\\x{{95}}]{_WS}+', ' ', 'g'), ' {{2,}}', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')) as cleaned from d),
f as (select *, case when contains(crlf, chr(13)) then 'ValueError' when len(list_filter(cleaned, lambda p: length(p) <> strlen(p))) > 0 then 'AssertionError' end as error,
      list_filter(cleaned, lambda p: length(regexp_replace(p, '[^a-zA-Z]+', '', 'g')) > 3 and not (contains(lower(regexp_replace(p, '[^a-zA-Z]+', '', 'g')), 'tableofcontents') and length(regexp_replace(p, '[^a-zA-Z]+', '', 'g')) <= 19)) as paragraphs from e)
"""


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").where("text is not null").where(~T.is_html(F.col("text"))).select("doc_id", "lang", "source", "text")
    return sections.paragraphs(d, resolve=False)


@query(_CLEAN + "select doc_id, generate_subscripts(paragraphs, 1) - 1 as para_no, unnest(paragraphs) as text from f where error is null")
def text_paragraphs(spark, folder):
    return _paragraphs(spark, folder).where("error is null").select("doc_id", F.posexplode("paragraphs").alias("para_no", "text"))


@query(_CLEAN + "select lang, source, count(*) as total, count(*) filter (where error is null) as good, round(count(*) filter (where error is null) * 100.0 / count(*), 0) as percent from f group by all")
def good_rate(spark, folder):
    return sections.good_rate(_paragraphs(spark, folder), ["lang", "source"])


@query(_CLEAN + "select error, count(*) as documents, sum(length(text)) as chars from f group by 1")
def paragraph_errors(spark, folder):
    return _paragraphs(spark, folder).groupBy(F.col("error.type").alias("error")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"))


_MARKED = """
select doc_id, doc_id % 3 = 2 as early,
    list_concat(list_concat(case doc_id % 5 when 1 then ['Part I'] when 2 then ['Part I', 'x', 'PART I.'] when 3 then ['part i', 'PART I', 'Part I.'] when 4 then ['Part II'] else ['cover'] end,
    case doc_id % 3 when 0 then ['Item 1A. Risk Factors'] when 1 then ['item 1a'] else ['ITEM 7. Management''s discussion'] end),
    list_concat(string_split(text, chr(10)), case when doc_id % 7 = 0 then ['end'] when doc_id % 7 = 1 then ['Item 2', 'Item 2.'] when doc_id % 3 = 2 then ['Item 8. Financial statements'] else ['Item 2. Properties'] end)) as p
from documents where text is not null"""


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").where("text is not null")
    sql = _MARKED.replace("chr(10)", "'\\n'").replace("''s", "\\'s").replace("string_split(", "split(").replace("list_concat(", "concat(").replace("['", "array('").replace("']", "')")
    body = sql[sql.index("concat(") : sql.rindex(" as p")]
    return d.select("doc_id", (F.col("doc_id") % 3 == 2).alias("early"), F.expr(body).alias("paragraphs"), F.lit(None).cast("struct<stage:string,type:string,message:string>").alias("error"))


@query(
    f"""with m as ({_MARKED}), k as (select *, list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], '(?i)^part i\\.?$')) as hits from m)
    select doc_id, case when len(hits) = 0 then len(p) when len(hits) <= 2 then len(p) - hits[len(hits)] + 1 end as paragraphs, case when len(hits) = 0 then p[1] when len(hits) <= 2 then p[hits[len(hits)]] end as first from k"""
)
def remove_header(spark, folder):
    p = T.remove_header(F.col("paragraphs"))
    return _marked(spark, folder).select("doc_id", F.when(p.isNotNull(), F.size(p)).alias("paragraphs"), F.try_element_at(p, F.lit(1)).alias("first"))


@query(
    f"""with m as ({_MARKED}),
    k as (select *, list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], case when early then '(?i)^item 7.? ?(management''s discussion)?' else '(?i)^item 1a.? ?(risk factors.*)?$' end)) as s,
                 list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], case when early then '(?i)^item 8.? ?(financial statements)?' else '(?i)^item 2.? ?(properties.*)?$' end)) as e from m),
    x as (select doc_id, case when len(s) = 1 and len(e) = 1 then p[s[1] + 1 : e[1] - 1] end as p, case when len(s) <> 1 or len(e) <> 1 then 'ParseError' end as error from k)
    select doc_id, error, case when p is null then -1 else coalesce(list_sum(list_transform(p, lambda t: length(t))), 0) end::bigint as chars, coalesce(len(p), -1) as paragraphs, left(p[1], 50) || ' ... ' || right(p[2], 50) as excerpt from x"""
)
def section_extract(spark, folder):
    out = sections.sections(_marked(spark, folder), F.col("early"))
    return out.select("doc_id", F.col("error.type").alias("error"), F.inline(F.array(T.section_summary(F.col("section")))))


_EARLY = "coalesce(year < 2006, false)"
_FORM = f"""case when doc_id % 6 = 0 then 'Part I' || sep || 'Part I' || sep || 'PART I.' || sep when doc_id % 6 = 1 then 'cover' || sep || 'Part I' || sep else '' end
    || case when {_EARLY} then 'Item 7. Management''s discussion' else 'Item 1A. Risk Factors' end || sep || text || sep || case when doc_id % 11 = 3 then 'the end' when {_EARLY} then 'Item 8. Financial statements' else 'Item 2. Properties' end || sep || 'last words'"""
_PARTED = f"""select *, {_FORM} as body from (select doc_id, form_type, year, text, case when regexp_matches(text, '</(p|div|td|P|DIV|TD)>') then '</p>' else chr(10) || chr(10) end as sep from documents where text is not null)"""
_SECTIONS = _DOCS.replace("from documents where text is not null)", "from bodies)").replace("|| text ||", "|| body ||").replace("with s as", f"with bodies as ({_PARTED}), s as")


@query(
    _SECTIONS
    + f""", m as (select doc_id, arg_min(text, k) as form from t where type = form_type group by 1),
    f as (select b.doc_id, {_EARLY} as early, m.form, regexp_matches(m.form, '</(p|div|td|P|DIV|TD)>') as html from bodies b left join m using (doc_id)),
    """
    + _CLEAN[_CLEAN.index("b as (") : _CLEAN.index("d as (")].replace("from a)", "from (select *, form as text from f))")
    + f"""dd as (select *, case when html then string_split(regexp_replace(regexp_replace(replace(replace(form, chr(10), ' '), chr(13), ' '), '</(?:p|div|tr|h1|h2|h3|h4|h5|title|P|DIV|TR|H1|H2|H3|H4|H5|TITLE)>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1))
        else string_split(replace(replace(regexp_replace(y, '\\n{_WS}*\\n', '<br />', 'g'), '-' || chr(10), ''), chr(10), ' '), '<br />') end as raw from c),
    """
    + _CLEAN[_CLEAN.index("e as (") : _CLEAN.index("f as (")].replace("from d)", "from dd)")
    + """g as (select *, case when form is null then 'ParseError' when not html and contains(replace(form, chr(13) || chr(10), chr(10)), chr(13)) then 'ValueError' when len(list_filter(cleaned, lambda p: length(p) <> strlen(p))) > 0 then 'AssertionError' end as failed,
        list_filter(cleaned, lambda p: length(regexp_replace(p, '[^a-zA-Z]+', '', 'g')) > 3 and not (contains(lower(regexp_replace(p, '[^a-zA-Z]+', '', 'g')), 'tableofcontents') and length(regexp_replace(p, '[^a-zA-Z]+', '', 'g')) <= 19)) as q from e),
    h as (select *, list_filter(range(1, len(q) + 1), lambda i: regexp_matches(q[i], '(?i)^part i\\.?$')) as hits from g),
    i as (select *, case when failed is not null then failed when len(hits) > 2 then 'ParseError' end as second, case when len(hits) = 0 then q else q[hits[len(hits)]:] end as r from h),
    j as (select *, list_filter(range(1, len(r) + 1), lambda i: regexp_matches(r[i], case when early then '(?i)^item 7.? ?(management''s discussion)?' else '(?i)^item 1a.? ?(risk factors.*)?$' end)) as starts,
        list_filter(range(1, len(r) + 1), lambda i: regexp_matches(r[i], case when early then '(?i)^item 8.? ?(financial statements)?' else '(?i)^item 2.? ?(properties.*)?$' end)) as stops from i),
    l as (select *, case when second is not null then second when len(starts) <> 1 or len(stops) <> 1 then 'ParseError' end as error from j)
    select doc_id, error, case when error is null then len(r[starts[1] + 1 : stops[1] - 1]) else -1 end as paragraphs, case when error is null then coalesce(list_sum(list_transform(r[starts[1] + 1 : stops[1] - 1], lambda t: length(t))), 0) else -1 end::bigint as chars from l"""
)
def sections_from_forms(spark, folder):
    d = read(spark, folder, "documents").where("text is not null")
    html = F.when(T.is_html(F.col("text")), "</p>").otherwise("\n\n")
    form = F.expr(_FORM.replace("Management''s", "Management\\'s"))
    d = d.select("doc_id", "form_type", F.expr(_EARLY).alias("early"), "year", "text", html.alias("sep")).withColumn("text", form)
    filings = d.select("doc_id", "form_type", "early", F.concat(F.lit("u"), "doc_id").alias("url"))
    submissions = d.select(F.concat(F.lit("u"), "doc_id").alias("url"), F.expr(_SUBMISSION.replace("chr(10)", "'\\n'")).alias("submission"))
    out = sections.from_forms(filings, submissions, F.col("early"))
    summary = T.section_summary(F.col("section"))
    return out.select("doc_id", F.col("error.type").alias("error"), F.inline(F.array(summary))).drop("excerpt")


@query()
def filing_paragraphs(spark, folder):
    forms = read(spark, folder, "raw_forms").select("form_id", "form_type", F.coalesce("bhtml", "btext").alias("raw"))
    main = F.coalesce(F.col("form_type") == "10-K", F.lit(False))
    out = sections.paragraphs(sections.decoded(forms), main=main)
    return out.select("form_id", F.size("paragraphs").alias("paragraphs"), F.col("error.type").alias("error"), F.col("error.stage").alias("stage"))


@query(
    """select doc_id, regexp_matches(text, '</(p|div|td|P|DIV|TD)>') as is_html, length(text) > 1000 as good_section, length(regexp_replace(text, '\\P{L}', '', 'g')) > 100 as is_paragraph,
    len(list_filter(string_split(text, chr(10)), lambda p: length(p) > 50)) as long_lines, replace(text, '“', '"') as straight, regexp_replace(text, '[^a-zA-Z ]', '', 'g') as letters,
    replace(replace(replace(text, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10)) as unwrapped from documents where text is not null"""
)
def text_predicates(spark, folder):
    c = F.col("text")
    d = read(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", T.is_html(c).alias("is_html"), (F.length(c) > 1000).alias("good_section"), T.is_paragraph(c).alias("is_paragraph"), F.size(T.long_lines(c)).alias("long_lines"), T.straight_quotes(c).alias("straight"), T.letters_only(c).alias("letters"), T.unwrap(c).alias("unwrapped"))


_SEARCHED = (*T.SEARCH_PATTERNS, "impairment", "dividend(s|en)?", "item 1a")


@query(
    "with p as (select unnest(["
    + ", ".join(f"'{p}'" for p in _SEARCHED)
    + """]) as pattern), h as (select doc_id, pattern, regexp_extract_all(chr(10) || text || chr(10), '(?i)\\n([^\\n]*(' || pattern || ')[^\\n]*)\\n', 1) as l from documents, p where text is not null)
    select doc_id, pattern, generate_subscripts(l, 1) - 1 as match_no, unnest(l) as line from h"""
)
def term_search(spark, folder):
    return reports.search(read(spark, folder, "documents"), ["doc_id"], patterns=_SEARCHED)


# ---- terms

_STOP = "[" + ", ".join(f"'{w}'" for w in terms.STOP_WORDS) + "]"
_LEMMA = "case when length(w) > 4 then regexp_replace(regexp_replace(lower(w), 'ies$', 'y'), '([^s])s$', '\\1') else lower(w) end"
_WORDS = rf"""with s as (select doc_id, lang, unnest(string_split_regex(text, '[.!?]+([ \n\t]|\z)')) as s from documents where text is not null),
    k as (select doc_id, lang, list_filter(regexp_extract_all(s, '[A-Za-z]+'), lambda w: not list_contains({_STOP}, lower(w))) as words from s),
    l as (select doc_id, lang, words, list_transform(words, lambda w: {_LEMMA}) as l from k where len(words) > 0)"""


def _grams(n: int, by: str) -> str:
    return f"{_WORDS}, g as (select {by}unnest(list_transform(range(1, len(l) - {n} + 2), lambda i: array_to_string(l[i:i + {n} - 1], ' '))) as term from l where len(l) >= {n})"


def _count(n: int):
    def run(spark, folder):
        return terms.ngram_counts(read(spark, folder, "documents"), [], n=(n,)).select("term", "cnt")

    return run


for _n, _name in ((1, "unigram_count"), (2, "bigram_count"), (3, "trigram_count")):
    QUERIES[_name] = _count(_n)
    ORACLE[_name] = f"{_grams(_n, '')} select term, count(*) as cnt from g group by 1"


@query(f"{_WORDS} select lang, sum(len(l)) as cnt from l group by 1")
def zerogram(spark, folder):
    return terms.ngram_counts(read(spark, folder, "documents"), ["lang"], n=(0,)).select("lang", "cnt")


@query(
    f"""{_WORDS}, g as (select lang, 1 as n, unnest(l) as term from l union all select lang, 2, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) from l),
    c as (select lang, n, term, count(*) as cnt from g group by all) select lang, n, term, cnt, row_number() over (partition by lang, n order by cnt desc, term) as rank from c qualify rank <= 10"""
)
def topk_terms_per_group(spark, folder):
    return terms.top_per_group(terms.ngram_counts(read(spark, folder, "documents"), ["lang"], n=(1, 2)), ["lang", "n"], 10)


@query("""select lang, lower(e) as term, count(*) as cnt from (select lang, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')) as e from documents) group by all""")
def entity_counts(spark, folder):
    return terms.entity_counts(read(spark, folder, "documents"), ["lang"])


@query(f"{_WORDS}, w as (select unnest(words) as w from l) select {_LEMMA} as stem, w as word, count(*) as cnt from w group by all")
def stem_words(spark, folder):
    return terms.stem_words(read(spark, folder, "documents"), [])


def _all_terms(by: str, source: str) -> str:
    """SQL of all terms by some columns of paragraphs `p` of a source."""
    return rf"""with s as (select {by}unnest(string_split_regex(p, '[.!?]+([ \n\t]|\z)')) as s from {source}),
    k as (select {by}list_filter(regexp_extract_all(s, '[A-Za-z]+'), lambda w: not list_contains({_STOP}, lower(w))) as words from s),
    l as (select {by}words, list_transform(words, lambda w: {_LEMMA}) as l from k where len(words) > 0),
    g as (select {by}0 as n, '' as term, len(l) as c from l union all select {by}1, unnest(l), 1 from l
        union all select {by}2, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])), 1 from l
        union all select {by}3, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])), 1 from l),
    w as (select {by}unnest(words) as w from l), e as (select {by}lower(unnest(regexp_extract_all(p, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'))) as term from {source})
    select {by}'entity' as kind, null::int as n, term, null::varchar as word, count(*) as cnt from e group by all
    union all select {by}'ngram', n, term, null, sum(c)::bigint from g group by all
    union all select {by}'stem', null, {_LEMMA}, w, count(*) from w group by all"""


_LINES = "(select doc_id, year, source, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) - 1 as para_no from documents where length(text) > 1000)"


def _paras(spark: SparkSession, folder: str) -> DataFrame:
    return terms.paragraphs_of(read(spark, folder, "documents"), ["doc_id", "year", "source"])


@query(_all_terms("doc_id, para_no, ", _LINES))
def terms_stage(spark, folder):
    return terms.all_terms(_paras(spark, folder), ["doc_id", "para_no"], "para")


@query(_all_terms("year, source, ", _LINES))
def quarter_terms(spark, folder):
    """Terms of documents added up to their groups, as the source system adds them up to quarters."""
    return terms.rolled_up(terms.all_terms(_paras(spark, folder), ["doc_id", "year", "source"], "para"), ["year", "source"])


@query(_all_terms("", _LINES))
def alltime_terms(spark, folder):
    return terms.rolled_up(terms.all_terms(_paras(spark, folder), ["year", "source"], "para"), [])


@query(
    f"""{_WORDS}, g as (select doc_id, unnest(l) as term from l union all select doc_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) from l
        union all select doc_id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) from l),
    d as (select doc_id, term, count(*) as n from g group by all), c as (select term, sum(n) as cnt from d group by 1),
    v as (select term from c qualify row_number() over (order by cnt desc, term) <= floor(0.18 * (select count(*) from c))), i as (select term, row_number() over (order by term) - 1 as word_id from v)
    select doc_id, string_agg(word_id || ':' || n, ' ' order by word_id) as bow from d join i using (term) group by 1"""
)
def bow_ngrams(spark, folder):
    counts = cut(terms.ngram_counts(read(spark, folder, "documents"), ["doc_id"], n=(1, 2, 3)), "ngrams")
    vocabulary = terms.cut_vocabulary(counts.groupBy("term").agg(F.sum("cnt").alias("cnt")), term="term")
    bags = terms.bags(counts, vocabulary, ["doc_id"])
    return bags.select("doc_id", _bag_text())


def _bag_text():
    return F.array_join(F.transform("bow", lambda e: F.concat(e["idx"].cast("string"), F.lit(":"), e["val"].cast("bigint").cast("string"))), " ").alias("bow")


_MAPS = "with m as (select year, qtr, unnest(map_keys(unstem_map)) as stem, unnest(map_values(unstem_map)) as m from para_stems), w as (select year, qtr, stem, unnest(map_keys(m)) as word, unnest(map_values(m)) as n from m), c as (select stem, word, sum(n)::bigint as cnt from w group by all)"


@query(_MAPS + ", r as (select *, row_number() over (partition by stem order by cnt desc, word) as rank from c) select stem, string_agg(word || ' ' || cnt, ',' order by cnt desc, word) as words from r where rank <= 10 group by 1")
def stem_report(spark, folder):
    return terms.stem_report(terms.stems_of_maps(read(spark, folder, "para_stems"), []))


@query(_MAPS + " select stem, string_agg(word || ' ' || cnt, ',' order by cnt desc, word) as words from c group by 1")
def stem_report_whole(spark, folder):
    return terms.stem_report(terms.stems_of_maps(read(spark, folder, "para_stems"), []), None)


@query(
    """with h as (select * from para_stems where counter is not null), m as (select year, qtr, unnest(map_keys(unstem_map)) as stem, unnest(map_values(unstem_map)) as m from h),
    w as (select distinct year, qtr, stem, unnest(map_keys(m)) as word from m), e as (select year, qtr, count(distinct stem) as stems, count(*) as forms from w group by all)
    select year, qtr, count(*) as paragraphs, sum(length)::bigint as words, any_value(stems) as stems, any_value(forms) as forms from h join e using (year, qtr) group by all"""
)
def quarter_statistics(spark, folder):
    return terms.quarter_statistics(read(spark, folder, "para_stems"), ["year", "qtr"])


@query("with e as (select qtr, unnest(map_keys(counter)) as stem, unnest(map_values(counter)) as n from para_stems), s as (select stem, sum(case when qtr <= 2 then n else -n end)::bigint as cnt from e group by 1) select * from s where cnt > 0")
def positive_sums(spark, folder):
    """What the first half of years has more of than the second."""
    e = read(spark, folder, "para_stems").select("qtr", F.explode("counter").alias("stem", "n"))
    return C.positive_sums(e.select("stem", F.when(F.col("qtr") <= 2, F.col("n")).otherwise(-F.col("n")).alias("cnt")), ["stem"], "cnt")


@query("select para_id, len(list_intersect(map_keys(counter), ['compli', 'insur', 'sell', 'fund'])) as common, len(list_distinct(map_keys(counter) || ['compli', 'insur', 'sell', 'fund'])) as either from para_stems where counter is not null")
def set_operations(spark, folder):
    rows = read(spark, folder, "para_stems").where("counter is not null")
    mine, stops = F.map_keys("counter"), F.array(*[F.lit(w) for w in ("compli", "insur", "sell", "fund")])
    return rows.select("para_id", F.size(C.common(mine, stops)).alias("common"), F.size(C.either(mine, stops)).alias("either"))


@query(_MAPS + " select stem, arg_min(word, (-cnt, word)) as word from c group by 1")
def stem_to_word(spark, folder):
    return terms.most_frequent_word(terms.stems_of_maps(read(spark, folder, "para_stems"), []))


_STEMS = "with e as (select year, qtr, unnest(map_keys(counter)) as stem, unnest(map_values(counter)) as n from para_stems), c as (select stem, sum(n)::bigint as cnt from e group by 1)"


@query(_STEMS + " select year, qtr, stem, sum(n)::bigint as cnt from e group by all")
def quarter_stems(spark, folder):
    return terms.stem_totals(read(spark, folder, "para_stems"), ["year", "qtr"])


_VOCAB = _STEMS + ", v as (select stem, cnt from c qualify row_number() over (order by cnt desc, stem) <= floor(0.18 * (select count(*) from c))), i as (select *, row_number() over (order by stem) - 1 as word_id from v)"


@query(_VOCAB + " select * from i")
def vocab_cut(spark, folder):
    return terms.cut_vocabulary(terms.stem_totals(read(spark, folder, "para_stems"), []))


@query(_STEMS + ", r as (select row_number() over (order by cnt desc, stem) - 1 as rank, * from c) select rank, stem, cnt, round(ln(1 + rank), 9) as log_rank, round(ln(1 + cnt / (select sum(cnt) from c)), 9) as log_freq from r")
def word_freq_rank(spark, folder):
    out = terms.word_frequencies(terms.stem_totals(read(spark, folder, "para_stems"), []))
    return out.withColumns({"log_rank": F.round("log_rank", 9), "log_freq": F.round("log_freq", 9)})


@query(_VOCAB + ", p as (select para_id, unnest(map_keys(counter)) as stem, unnest(map_values(counter)) as n from para_stems) select para_id, string_agg(word_id || ':' || n, ' ' order by word_id) as bow from p join i using (stem) group by 1")
def bow(spark, folder):
    rows = read(spark, folder, "para_stems")
    vocabulary = terms.cut_vocabulary(terms.stem_totals(rows, []))
    counts = rows.select("para_id", F.explode("counter").alias("stem", "cnt"))
    bags = terms.bags(counts, vocabulary, ["para_id"], "stem")
    return bags.select("para_id", _bag_text())


@query(
    _VOCAB
    + ", p as (select year, para_id, unnest(map_keys(counter)) as stem, unnest(map_values(counter)) as n from para_stems), b as (select year, para_id, list(word_id order by word_id) as ids from p join i using (stem) group by all) select year, count(*) as bags, sum(len(ids))::bigint as entries, max(len(ids)) as longest from b group by 1"
)
def corpus_by_year(spark, folder):
    """The bags of each year, as the models read them: their number and size."""
    rows = read(spark, folder, "para_stems")
    vocabulary = terms.cut_vocabulary(terms.stem_totals(rows, []))
    bags = terms.bags(rows.select("year", "para_id", F.explode("counter").alias("stem", "cnt")), vocabulary, ["year", "para_id"], "stem")
    return bags.groupBy("year").agg(F.count(F.lit(1)).alias("bags"), F.sum(F.size("bow")).alias("entries"), F.max(F.size("bow")).alias("longest"))


@query("with e as (select para_id, unnest(map_keys(counter)) as stem, unnest(map_values(counter)) as n from para_stems) select para_id, stem, n as cnt from e where stem not in ('compli', 'insur', 'sell', 'fund')")
def without_stop_stems(spark, folder):
    counts = read(spark, folder, "para_stems").select("para_id", F.explode("counter").alias("stem", "cnt"))
    stops = spark.createDataFrame([("compli",), ("insur",), ("sell",), ("fund",)], "stem string")
    return terms.without(counts, stops)


@query(
    """with e as (select para_id, unnest(map_keys(counter)) as term, unnest(map_values(counter)) as n from para_stems), d as (select term, count(*) as df from e group by 1),
    w as (select para_id, term, (1 + log2(n)) * log2((select count(counter) from para_stems) / df) as w from e join d using (term)), k as (select para_id, sqrt(sum(w * w)) as norm from w group by 1)
    select para_id, term, round(w / norm, 6) as weight from w join k using (para_id) where norm > 0"""
)
def tfidf_ltc(spark, folder):
    rows = read(spark, folder, "para_stems")
    counts = rows.select("para_id", F.explode("counter").alias("term", "cnt"))
    return terms.tfidf(counts, rows.where("counter is not null").count(), "para_id").withColumn("weight", F.round("weight", 6))


@query(
    f"""{_WORDS}, u as (select unnest(l) as term from l), uc as (select term, count(*)::double as c from u group by 1), n as (select count(*)::double as n from u),
    b as (select unnest(list_transform(range(1, len(l)), lambda i: [l[i], l[i + 1]])) as p from l where len(l) > 1), bc as (select p[1] as first, p[2] as second, count(*) as cnt from b group by all),
    t as (select first, second, cnt, x.c as a, y.c as b, n from bc join uc x on x.term = first join uc y on y.term = second, n)
    select first, second, cnt, round(2 * (cnt * ln(cnt * n / (a * b)) + case when b > cnt then (b - cnt) * ln((b - cnt) * n / ((n - a) * b)) else 0 end
    + case when a > cnt then (a - cnt) * ln((a - cnt) * n / (a * (n - b))) else 0 end + case when n - a - b + cnt > 0 then (n - a - b + cnt) * ln((n - a - b + cnt) * n / ((n - a) * (n - b))) else 0 end), 3) as score
    from t where score > 35"""
)
def bigram_likelihood(spark, folder):
    counts = terms.ngram_counts(read(spark, folder, "documents"), [], n=(0, 1, 2))
    return terms.bigram_likelihood(counts).withColumn("score", F.round("score", 3)).where("score > 35")


@query(
    f"""with d as (select doc_id, string_split(text, chr(10)) as p from documents where length(text) > 1000), x as (select doc_id, generate_subscripts(p, 1) - 1 as para_no, unnest(p) as p from d),
    y as (select doc_id, para_no, list_transform(list_filter(regexp_extract_all(p, '[A-Za-z]+'), lambda w: not list_contains({_STOP}, lower(w))), lambda w: {_LEMMA}) as l from x),
    c as (select doc_id, para_no, unnest(l) as stem from y), n as (select doc_id, para_no, stem, count(*) as n from c group by all)
    select doc_id, para_no, count(*) as stems, sum(n)::bigint as length, max(n) as most from n group by all having count(*) > 50"""
)
def paragraph_stems(spark, folder):
    out = terms.paragraph_stems(read(spark, folder, "documents"), ["doc_id"])
    return out.select("doc_id", "para_no", F.size("counter").alias("stems"), "length", F.array_max(F.map_values("counter")).alias("most"))


@query("with w as (select doc_id, regexp_extract_all(text, '[A-Za-z]+') as w from documents where text is not null) select doc_id, array_to_string(list_transform(range(1, len(w) + 1, 3), lambda i: array_to_string(w[i:i + 2], ' ')), '|') as chunks from w")
def word_chunks(spark, folder):
    d = read(spark, folder, "documents").where("text is not null")
    d = result.once(d, "words", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    chunks = C.chunks(F.col("words"), 3)
    return d.select("doc_id", F.array_join(F.transform(chunks, lambda c: F.array_join(c, " ")), "|").alias("chunks"))


# ---- topics

#: Topics of the latent semantic indexing.
LSI_TOPICS = 500
#: Terms whose frequencies go to all tasks.
HELD_TERMS = 1_000_000
_FLAT = "with f as (select para_id, year, qtr, coalesce(length, 0) as w, unnest(topic_vec) as e from para_stems)"
_QT = _FLAT + ", s as (select year, qtr, e.topic as topic, sum(e.val * w) as weighted, sum(e.val) as unweighted, count(*) as pairs from f group by all), t as (select year, qtr, sum(coalesce(length, 0)) as weights, count(*) as docs from para_stems where len(topic_vec) > 0 group by all)"


@query(_QT + " select year, qtr, topic, round(weighted, 6) as weighted, round(unweighted, 6) as unweighted, pairs from s")
def quarter_topics(spark, folder):
    return topics.quarter_topics(read(spark, folder, "para_stems")).withColumns({"weighted": F.round("weighted", 6), "unweighted": F.round("unweighted", 6)})


@query(_QT + " select topic, year, round(avg(weighted / greatest(weights, 1)), 6) as weighted, round(avg(unweighted / greatest(docs, 1)), 6) as unweighted from s join t using (year, qtr) group by all")
def topic_prevalence(spark, folder):
    return topics.prevalence(read(spark, folder, "para_stems")).withColumns({"weighted": F.round("weighted", 6), "unweighted": F.round("unweighted", 6)})


@query(_FLAT + " select para_id, row_number() over (partition by para_id order by e.val desc, e.topic) as rank, e.topic as topic, e.val as val from f qualify rank <= 10")
def top_topics(spark, folder):
    return topics.top_topics(read(spark, folder, "para_stems"), "para_id")


_WEIGHTS = "select e.topic as topic, stem as word, sum(e.val * n) as weight from (select para_id, unnest(topic_vec) as e from para_stems) join (select para_id, unnest(map_keys(counter)) as stem, unnest(map_values(counter)) as n from para_stems) using (para_id) group by all"


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    flat = read(spark, folder, "para_stems").select(F.explode("topic_vec").alias("e"), "counter").select("e", F.explode("counter").alias("word", "n"))
    return flat.groupBy(F.col("e.topic").alias("topic"), "word").agg(F.sum(F.col("e.val") * F.col("n")).alias("weight"))


@query(f"with w as (select topic, word, round(weight, 6) as weight from ({_WEIGHTS})) select topic, row_number() over (partition by topic order by weight desc, word) as rank, word, weight from w qualify rank <= 50")
def topic_words(spark, folder):
    return topics.top_words(_weights(spark, folder).withColumn("weight", F.round("weight", 6)))


def _kept_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, counts of its stems by record)."""
    vocabulary = terms.cut_vocabulary(terms.stem_totals(rows, []))
    counts = rows.select("para_id", F.explode("counter").alias("stem", "cnt"))
    return vocabulary, counts.join(vocabulary.select("stem"), "stem", "left_semi")


@query()
def lsi_topics(spark, folder):
    rows = read(spark, folder, "para_stems")
    totals = cut(rows.select(F.explode("counter").alias("stem", "_n")).groupBy("stem").agg(F.sum("_n").alias("cnt"), F.count(F.lit(1)).alias("df")), "totals")
    vocabulary = cut(terms.cut_vocabulary(totals.select("stem", "cnt")).join(totals.select("stem", "df"), "stem"), "vocabulary")
    bags = terms.tfidf_bags(rows, vocabulary, rows.where("counter is not null").count())
    values, found = topics.lsi(bags, vocabulary.count(), LSI_TOPICS)
    # the words are few beside topics times words, which Spark takes for the smaller side
    return topics.top_words(found.join(F.broadcast(vocabulary), "word_id").withColumnRenamed("stem", "word"))


@query()
def lda_topics(spark, folder):
    vocabulary, counts = _kept_counts(read(spark, folder, "para_stems"))
    return topics.top_words(topics.lda(counts, vocabulary, "para_id", 20).withColumnRenamed("stem", "word"))


@query(
    f"""with w as (select topic, word, round(weight, 6) as weight from ({_WEIGHTS})), t as (select topic, word, weight, row_number() over (partition by topic order by weight desc, word) as rank from w qualify rank <= 50),
    e as (select para_id, unnest(map_keys(counter)) as term, unnest(map_values(counter)) as n from para_stems), d as (select term, count(*) as df from e group by 1),
    x as (select para_id, term, (1 + log2(n)) * log2((select count(counter) from para_stems) / df) as v from e join d using (term)), k as (select para_id, sqrt(sum(v * v)) as norm from x group by 1),
    u as (select para_id, term, v / norm as v from x join k using (para_id) where norm > 0), s as (select para_id, topic, round(sum(v * weight), 3) as val from u join t on term = word group by all)
    select para_id, row_number() over (partition by para_id order by val desc, topic) as rank, topic, val from s qualify rank <= 10"""
)
def project_topics(spark, folder):
    """Records by their weights against the words of topics: the ten topics nearest to each."""
    rows = read(spark, folder, "para_stems").where("para_id is not null")
    documents = read(spark, folder, "para_stems").where("counter is not null").count()
    counts = read(spark, folder, "para_stems").select("para_id", F.explode("counter").alias("term", "cnt"))
    frequencies = cut(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    words = topics.top_words(topics.word_weights(read(spark, folder, "para_stems"), frequencies).withColumn("weight", F.round("weight", 6)))
    if frequencies.count() <= HELD_TERMS and rows.groupBy("para_id").count().where("count > 1").isEmpty():
        return topics.nearest(rows.select("para_id", F.col("counter").alias("entries")), words, "para_id", 10, frequencies, documents)
    # more terms than go to all tasks, or records in several rows: both are brought together by shuffles
    weights = terms.tfidf(counts, documents, "para_id")
    records = weights.groupBy("para_id").agg(F.collect_list(F.struct("term", "weight")).alias("entries"))
    return topics.nearest(records, words, "para_id")


# ---- reports

_SAMPLES = "select unnest([['all'], ['all', event_type], ['all', event_type, 'u' || (user_id % 3)]]) as path, value as duration, user_id as memory from events"


@query(
    f"""with x as ({_SAMPLES}), e as (select path, count(*) as n, sum(duration) as s, avg(duration) as mean, coalesce(stddev_samp(duration), 0) as std, avg(memory) as mm, coalesce(stddev_samp(memory), 0) as ms from x group by 1)
    select array_to_string(e.path, '/') as path, e.n, round(e.mean, 6) as mean, round(e.std, 6) as std, round(e.s * 100 / p.s, 6) as of_parent, round(e.s * 100 / d.s, 6) as of_second, round(e.mm, 6) as memory_mean, round(e.ms, 6) as memory_std
    from e left join e p on p.path = e.path[1:len(e.path) - 1] left join e d on d.path = e.path[1:2]"""
)
def timing_report(spark, folder):
    e = read(spark, folder, "events")
    u = F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))
    paths = F.array(F.array(F.lit("all")), F.array(F.lit("all"), "event_type"), F.array(F.lit("all"), F.col("event_type"), u))
    out = reports.timing_report(e.select(F.explode(paths).alias("path"), F.col("value").alias("duration"), F.col("user_id").alias("memory")), "memory")
    return out.select(F.array_join("path", "/").alias("path"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "of_parent", "of_second", "memory_mean", "memory_std")])


@query("select lang, row_number() over (partition by lang order by n_chars nulls first) as rank, n_chars from documents")
def sorted_lengths(spark, folder):
    return sections.ranked(read(spark, folder, "documents"), "n_chars", ["lang"])


@query(
    """with n as (select doc_id, n_chars, case when n_chars >= 1 then least(4, floor(ln(n_chars) / ln(1024) + 1e-12)) else 0 end as p from documents where n_chars is not null)
    select doc_id, cast(round(n_chars / pow(1024, p), 0) as bigint) || ' ' || ['b', 'Kb', 'Mb', 'Gb', 'Tb'][cast(p as int) + 1] as size from n"""
)
def human_sizes(spark, folder):
    d = read(spark, folder, "documents").where("n_chars is not null")
    return d.select("doc_id", C.human_bytes(F.col("n_chars")).alias("size"))


@query()
def sample_rows(spark, folder):
    return C.sampled(read(spark, folder, "documents").select("doc_id"), 0.1, 0)


@query("select doc_id, n_chars from documents order by n_chars desc nulls last, doc_id limit 10")
def take_rows(spark, folder):
    return C.taken(read(spark, folder, "documents").select("doc_id", "n_chars"), 10, [F.desc_nulls_last("n_chars"), F.col("doc_id")])


FLAGSHIP = QUERIES["bigram_count"]
