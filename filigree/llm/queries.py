"""Queries of the operators in this package, over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import chosenpath, clusters, garbled, leakage, lookalike, packing, termcounts


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.garbled_forms(_read(spark, folder, "raw_forms")).where("garbled").select("form_id", "field")


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.garbled_forms(_read(spark, folder, "raw_forms")).where("garbled").select("form_id", "field", F.concat_ws(", ", "channels").alias("channels"), "text")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return chosenpath.similar_pairs(_read(spark, folder, "para_stems")).select("para_id_a", "para_id_b")


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return chosenpath.similar_classes(_read(spark, folder, "para_stems"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.clustered(_read(spark, folder, "para_stems")).select("para_id", "cluster_id")


def p3_typical(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.typical_members(clusters.clustered(_read(spark, folder, "para_stems"))).select("cluster_id", "size", "rank", "para_id", F.round("typicality", 6).alias("typicality"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return termcounts.marked_terms(_read(spark, folder, "para_stems")).where("mark is not null").select("field", "term", "mark")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return termcounts.marked_terms(_read(spark, folder, "para_stems")).select("field", "term", "total", "records", "mark")


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"), _read(spark, folder, "pack_specs"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    specs = _read(spark, folder, "pack_specs")
    return packing.packing_report(packing.pack(_read(spark, folder, "documents"), specs), specs)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_reparametrised(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"), reparametrised=True)
    return found.where("not verbatim").select("doc_id", "item_id", "windows")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.look_pairs(_read(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.canonical_texts(_read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_classes, p3_found, p3_typical, p4_found, p4_counts, p6_pack, p6_report, p7_found, p7_reparametrised, p8_found, p8_forms)}

_ENTRIES = """
with entries as (
    select 'counter' as field, para_id, unnest(map_keys(counter)) as term, unnest(map_values(counter)) as n from para_stems
    union all
    select 'unstem_map', para_id, unnest(map_keys(m)), unnest(map_values(m))
    from (select para_id, unnest(map_values(unstem_map)) as m from para_stems)
), held as (
    select 'counter' as field, count(counter) as rows from para_stems
    union all select 'unstem_map', count(unstem_map) from para_stems
), counts as (
    select field, term, sum(n)::bigint as total, count(distinct para_id) as records from entries group by field, term
), marked as (
    select field, term, total, records,
           case when records <= 2 then 'rare' when records * 5 > rows then 'common' end as mark
    from counts join held using (field)
)
"""

_UNIT = """
with dims as (
    select para_id, e.topic as topic, sum(e.val) as val
    from (select para_id, unnest(topic_vec) as e from para_stems) group by all
), unit as (
    select para_id, topic, val / sqrt(sum(val * val) over (partition by para_id)) as val from dims
), near as (
    select a.para_id as a, b.para_id as b
    from unit a join unit b on a.topic = b.topic
    group by 1, 2 having sum(a.val * b.val) >= 0.7
), clusters as (
    select a as para_id, min(b) as cluster_id, count(*) as size from near group by a
)
"""

#: What characters become, for SQL: spaces, hyphens, full-width forms and look-alike letters, one for one.
_FROM = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_TO = " " * len(_FROM)
_FROM += "\u2010\u2011" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_TO += "--" + "".join(chr(c) for c in range(0x21, 0x7F))
# Look-alike letters and the Latin ones, listed for the SQL by themselves.
for _other, _latin in (("АВЕЅІЈКМНОРСТУХ", "ABESIJKMHOPCTYX"), ("аеѕіјорсухһԁԛԝӏ", "aesijopcyxhdqwl"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"), ("ԚԜҮӀՍՕօ", "QWYIUOo")):
    _FROM, _TO = _FROM + _other, _TO + _latin
_QUOTED = _TO.replace("'", "''")
_FORMS = f"""
with forms as (
    select doc_id, text, nfc_normalize(translate(regexp_replace(replace(replace(replace(text, '\ufb00', 'ff'), '\ufb01', 'fi'), '\ufb02', 'fl'),
        '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '{_FROM}', '{_QUOTED}')) as form
    from TABLE_ where text <> ''
)
"""
_RUNS = _FORMS + """, words as (
    select doc_id, regexp_extract_all(translate(lower(form), '\u0432\u043a\u043c\u043d\u0442', 'bkmht'), '[\\pL\\p{Nd}]+') as w from forms
), runs as (
    select doc_id, unnest(list_transform(range(1, len(w) - 13), lambda i: array_to_string(w[i:i + 14], ' '))) as run from words where len(w) >= 15
) select distinct doc_id, run from runs
"""

ORACLE = {
    "p8_found": _FORMS.replace("TABLE_", "documents") + "select a.doc_id as doc_id_a, b.doc_id as doc_id_b from forms a join forms b using (form) where a.doc_id < b.doc_id and a.text <> b.text",
    "p7_found": f"select distinct d.doc_id, i.doc_id as item_id from ({_RUNS.replace('TABLE_', 'documents')}) d join ({_RUNS.replace('TABLE_', '(select item_id as doc_id, text from eval_items)')}) i using (run)",
    "p2_found": """
with grams as (
    select para_id, unnest(map_keys(counter)) as stem, unnest(map_values(counter)) as n from para_stems where counter is not null
), sizes as (
    select para_id, sum(n) as size from grams group by para_id
), shared as (
    select a.para_id as para_id_a, b.para_id as para_id_b, sum(least(a.n, b.n)) as least
    from grams a join grams b on a.stem = b.stem and a.para_id < b.para_id group by 1, 2
)
select para_id_a, para_id_b
from shared join sizes s on s.para_id = para_id_a join sizes t on t.para_id = para_id_b
where 4 * least >= 3 * (s.size + t.size - least)
""",
    "p2_classes": """
with sets as (
    select para_id, case when cardinality(counter) > 0 then list_sort(map_entries(counter))::varchar end as name from para_stems
), named as (
    select para_id, name, min(para_id) over (partition by name) as class_id, count(*) over (partition by name) as copies from sets where name is not null
), grams as (
    select para_id, unnest(map_keys(counter)) as stem, unnest(map_values(counter)) as n from para_stems where para_id in (select class_id from named)
), sizes as (
    select para_id, sum(n) as size from grams group by para_id
), shared as (
    select a.para_id as a, b.para_id as b, sum(least(a.n, b.n)) as least from grams a join grams b on a.stem = b.stem and a.para_id <> b.para_id group by 1, 2
), links as (
    select a as class_id, count(*) as links from shared join sizes s on s.para_id = a join sizes t on t.para_id = b where 4 * least >= 3 * (s.size + t.size - least) group by 1
)
select para_id, coalesce(class_id, para_id) as class_id, coalesce(copies, 1) as copies, coalesce(links, 0) as links
from sets left join named using (para_id) left join links using (class_id)
""",
    "p3_typical": _UNIT
    + """, members as (select * from clusters where size >= 3
), sums as (
    select cluster_id, topic, sum(val) as val from members join unit using (para_id) group by all
), norms as (
    select cluster_id, sqrt(sum(val * val)) as norm from sums group by 1
), typical as (
    select para_id, cluster_id, any_value(size) as size, sum(u.val * s.val) / any_value(norm) as typicality
    from members join unit u using (para_id) join sums s using (cluster_id, topic) join norms using (cluster_id) group by all
), ranked as (
    select *, row_number() over (partition by cluster_id order by round(typicality, 9) desc, para_id) as rank from typical
) select cluster_id, size, rank, para_id, round(typicality, 6) as typicality from ranked where rank <= 3""",
    "p3_found": _UNIT + "select para_id, cluster_id from clusters where size >= 3",
    "p4_found": _ENTRIES + "select field, term, mark from marked where mark is not null",
    "p4_counts": _ENTRIES + "select field, term, total, records, mark from marked",
}
