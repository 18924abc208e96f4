import random
from collections import Counter

from filigree.llm.termcounts import marked_terms, term_counts

ROWS = "para_id bigint, counter map<string,bigint>, unstem_map map<string,map<string,bigint>>, term string, total int"


def brute(rows):
    total, records = Counter(), Counter()
    for _, counter, nested, _, _ in rows:
        for k, v in (counter or {}).items():
            total["counter", k] += v or 0
            records["counter", k] += 1
        seen = set()
        for m in (nested or {}).values():
            for k, v in (m or {}).items():
                total["unstem_map", k] += v or 0
                seen.add(k)
        for k in seen:
            records["unstem_map", k] += 1
    return {k: (total[k], records[k]) for k in records}


def test_against_brute_force(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        counter = {f"t{int(r.paretovariate(0.7)) % 900}": r.randint(1, 9) for _ in range(r.randint(0, 12))}
        nested = {k: {k + "s": 1, r.choice(("common", "Common", k)): v} for k, v in counter.items()}
        rows.append((i, None if i % 17 == 0 else counter, None if i % 17 == 0 else nested, "x", 1))
    rows += [(1, rows[1][1], rows[1][2], "copy", 2), (999, {"n": None}, {"n": None}, None, None)]
    df = spark.createDataFrame(rows, ROWS)
    want = brute(rows)
    for part_rows in (2_000_000, 20):
        got = {(x.field, x.term): (x.total, x.records) for x in term_counts(df, part_rows=part_rows).collect() if x.term is not None}
        assert got == want
    n = sum(x[1] is not None for x in rows)
    for x in marked_terms(df).collect():
        records = want[x.field, x.term][1]
        assert x.mark == ("rare" if records <= 2 else "common" if records * 5 > n else None)


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert marked_terms(df).count() == 0
    assert marked_terms(spark.createDataFrame([(1, None, None, None, None), (2, {}, {}, None, None)], ROWS)).count() == 0
