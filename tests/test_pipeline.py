"""Index files, memo, terms, topics and reports on small inputs."""

import math
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree import result
from filigree.functions import collections as C
from filigree.operators import reports, sections, terms, topics
from filigree.plans import queries
from filigree.session import shared_dir
from filigree.sources import index, sinks, termlist
from filigree.store import Memo, MemoryMemo, TableMemo, canonical, cut, discard, free

INDEX = """Made-up index, for a test
of five lines
that stand before
the names of
the columns

Form Type    Company Name                       CIK        Date Filed    File Name
------------------------------------------------------------------------------------
20-X         BLUE KETTLE WORKS                  41007      2001-02-09    edgar/data/41007/k-1.txt
20-Y         QUIET HARBOR CO  /TX/              700412     2003-11-05    edgar/data/700412/q-7.txt
20-Y         LATE LAMP LTD                      700413     2003-11-3X    edgar/data/700413/l-2.txt
one piece"""


def test_index_from_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "made.zip", "w") as z:
        z.writestr("lines.idx", INDEX)
    lines = index.read_zipped_lines(spark, str(tmp_path), "lines.idx").withColumns({"year": F.lit(2001), "qtr": F.lit(1)})
    assert lines.count() == 12
    got = index.parse_body(lines, "path").orderBy("line_no").collect()
    assert [r.error.type if r.error else None for r in got] == [None, None, "ValueError", "ParseError"]
    assert (got[0].cik, str(got[0].date_filed), got[0].url) == (41007, "2001-02-09", index.ARCHIVES + "edgar/data/41007/k-1.txt")
    assert got[1].company_name == "QUIET HARBOR CO /TX/"
    scanned = index.scan(lines, "20-Y", "path").collect()
    assert [(r.cik, r.violations) for r in scanned] == [(700412, ["date_filed"])]
    assert [r.violations for r in index.scan(lines, "20-X", "path").collect()] == [[]]
    assert index.scan(lines.limit(0), "20-X", "path").count() == 0


def test_first_run(spark):
    rows = [(1, "f", "a"), (2, "f", "x"), (3, "f", "x"), (4, "f", None), (5, "f", "x"), (1, "g", "x")]
    df = spark.createDataFrame(rows, "line_no int, file string, form_type string")
    got = index.first_run(df, "x", [F.col("line_no")], ["file"]).orderBy("file", "line_no").collect()
    assert [(r.file, r.line_no) for r in got] == [("f", 2), ("f", 3), ("g", 1)]
    assert index.first_run(df, "none", [F.col("line_no")], ["file"]).count() == 0
    with pytest.raises(ValueError):
        index.first_run(df, "x", [F.col("line_no")], [])


def test_year_range(spark):
    df = spark.createDataFrame([(y, q) for y in (2000, 2001, 2002) for q in (1, 2, 3, 4)], "year int, qtr int")
    assert index.year_range(df, 2000, 2001).count() == 8 and index.year_range(df, 2000, 2001, (1, 2, 3)).count() == 6


def test_memo(spark, tmp_path):
    made = []

    def words(text, times=1):
        made.append((text, times))
        return spark.createDataFrame([(w,) for w in text.split() * times], "w string")

    memo = Memo(spark, f"file://{tmp_path}")
    assert memo("words", words, text="red blue").count() == 2 and memo("words", words, text="red blue", times=3).count() == 6
    assert memo("words", words, text="red blue").count() == 2
    assert made == [("red blue", 1), ("red blue", 3)] and (memo.hits, memo.misses) == (1, 2)
    memo.clear("words")
    assert memo("words", words, text="red blue").count() == 2 and len(made) == 3
    assert memo("words", words, version="b", text="red blue").count() == 2 and len(made) == 4
    assert Memo(spark, f"file://{tmp_path}", enabled=False)("words", words, text="red").count() == 1 and len(made) == 5
    assert canonical({"b": 1, "a": [1.00001, "x"]}) == canonical({"a": (1.0, "x"), "b": 1})
    with pytest.raises(TypeError):
        canonical(object())


@pytest.mark.parametrize("kind", ["memory", "table", "folder"])
def test_stores_of_the_memo(spark, tmp_path, kind):
    made = []
    memo = {"memory": lambda: MemoryMemo(spark), "table": lambda: TableMemo(spark, f"file://{tmp_path}"), "folder": lambda: Memo(spark, f"file://{tmp_path}")}[kind]()

    @memo.decor("letters", "v1")
    def letters(word):
        made.append(word)
        return spark.createDataFrame([(c,) for c in word], "c string")

    threads = [threading.Thread(target=lambda: letters(word="lamp").count()) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert made == ["lamp"] and (memo.hits, memo.misses) == (2, 1)
    assert sorted(r.c for r in letters(word="tea").collect()) == ["a", "e", "t"] and letters(word="lamp").columns == ["c"]
    assert made == ["lamp", "tea"]
    memo.clear("letters")
    assert letters(word="tea").count() == 3 and made == ["lamp", "tea", "tea"]


def test_tables_are_freed(spark):
    one, two = cut(spark.range(3)), cut(spark.range(4))
    discard(one)
    assert two.count() == 4
    with pytest.raises(Exception, match="(?i)not.?(found|exist)"):
        one.count()
    discard(spark.range(2))
    assert free(spark) >= 1 and free(spark) == 0


def test_a_cluster_names_its_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Cluster())


def test_terms(spark):
    df = spark.createDataFrame([(1, "The cats chase policies. A dog runs"), (2, None), (3, ""), (4, "of the")], "doc_id int, text string")
    got = {(r.n, r.term): r.cnt for r in terms.ngram_counts(df, []).collect()}
    assert got == {(0, ""): 5, (1, "cats"): 1, (1, "chase"): 1, (1, "policy"): 1, (1, "dog"): 1, (1, "runs"): 1, (2, "cats chase"): 1, (2, "chase policy"): 1, (2, "dog runs"): 1, (3, "cats chase policy"): 1}
    assert terms.ngram_counts(df.limit(0), []).count() == 0


def test_vocabulary_ranks_and_bags(spark):
    totals = spark.createDataFrame([(f"w{i:03d}", 1000 - i // 2) for i in range(200)], "stem string, cnt bigint").repartition(7)
    kept = terms.cut_vocabulary(totals, 0.1).orderBy("word_id").collect()
    assert [r.stem for r in kept] == [f"w{i:03d}" for i in range(20)] and [r.word_id for r in kept] == list(range(20))
    counts = spark.createDataFrame([(1, "w003", 2), (1, "w001", 1), (2, "none", 4)], "k int, stem string, cnt int")
    bags = terms.bags(counts, terms.cut_vocabulary(totals, 0.1), ["k"], "stem").collect()
    assert [(r.k, [tuple(e) for e in r.bow]) for r in bags] == [(1, [(1, 1.0), (3, 2.0)])]


def test_tfidf_has_length_one(spark):
    counts = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "a", 1)], "doc_id int, term string, cnt bigint")
    got = {(r.doc_id, r.term): r.weight for r in terms.tfidf(counts, 2).collect()}
    assert got == {(1, "a"): 0.0, (1, "b"): 1.0}


def test_bigram_likelihood(spark):
    counts = spark.createDataFrame([(0, "", 100), (1, "a", 10), (1, "b", 20), (2, "a b", 8)], "n int, term string, cnt bigint")
    got = terms.bigram_likelihood(counts).first().score
    table = [(8, 10 * 20), (12, 90 * 20), (2, 10 * 80), (78, 90 * 80)]
    assert math.isclose(got, 2 * sum(o * math.log(o * 100 / e) for o, e in table))


def test_rare_bigrams_are_scored(spark, tmp_path):
    text = ". ".join(["zebra quagga"] * 5 + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)} filler" for i in range(400)])
    spark.createDataFrame([(1, text)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.first, r.second): r.cnt for r in queries.QUERIES["bigram_likelihood"](spark, str(tmp_path)).collect()}
    assert got["zebra", "quagga"] == 5


def test_topics(spark):
    rows = spark.createDataFrame([(1, 2000, 1, 10, [(1, 0.5), (2, -0.25)]), (2, 2000, 1, None, [(1, 1.0)]), (3, 2000, 2, 5, None), (4, 2000, 2, 5, [])], "para_id int, year int, qtr int, length bigint, topic_vec array<struct<topic:int,val:double>>")
    got = {(r.topic, r.year): (r.weighted, r.unweighted) for r in topics.prevalence(rows).collect()}
    assert got == {(1, 2000): (0.5, 0.75), (2, 2000): (-0.25, -0.125)}
    best = topics.top_topics(rows, "para_id", k=1).orderBy("para_id").collect()
    assert [(r.para_id, r.topic) for r in best] == [(1, 1), (2, 1)]


def test_lsi_keeps_the_norm(spark):
    bows = spark.createDataFrame([([(0, 3.0)],), ([(1, 4.0)],)], "bow array<struct<idx:int,val:double>>")
    values, found = topics.lsi(bows, 2, 2)
    assert [round(v, 6) for v in values] == [4.0, 3.0]
    assert {(r.topic, r.word_id): abs(round(r.weight, 6)) for r in found.collect()}[0, 1] == 1.0


def test_lsi_like_an_exact_decomposition(spark):
    r = np.random.default_rng(4)
    dense = r.random((60, 17)) * (r.random((60, 17)) < 0.4)
    rows = [([(int(j), float(row[j])) for j in np.flatnonzero(row)],) for row in dense] + [([],), (None,)]
    bows = spark.createDataFrame(rows, "bow array<struct<idx:int,val:double>>").repartition(3)
    values, found = topics.lsi(bows, 17, 5)
    _, exact, vectors = np.linalg.svd(dense)
    assert np.allclose(values, exact[:5])
    mine = np.zeros((5, 17))
    for t in found.collect():
        mine[t.topic, t.word_id] = t.weight
    assert np.allclose(np.abs((mine * vectors[:5]).sum(1)), 1)
    assert topics.lsi(bows.limit(0), 17, 5)[0] == []


def test_lsi_of_a_matrix_that_no_task_and_no_driver_holds(spark, monkeypatch):
    r = np.random.default_rng(5)
    dense = r.random((400, 150)) * (r.random((400, 150)) < 0.2) * np.linspace(2, 0.1, 150)
    dense[:, 140:] = 0  # words that no record has
    rows = [([(int(j), float(row[j])) for j in np.flatnonzero(row)],) for row in dense]
    bows = spark.createDataFrame(rows, "bow array<struct<idx:int,val:double>>").repartition(3)
    for name, value in (("PAIRS", 50), ("SLAB", 8 * 150 * 4), ("HELD", 8 * 150 * 20), ("BLOCK", 4), ("BEYOND", 14)):
        monkeypatch.setattr(topics, name, value)
    values, found = topics.lsi(bows, 150, 12)
    _, exact, vectors = np.linalg.svd(dense)
    assert np.allclose(values, exact[:12])
    mine = np.zeros((12, 150))
    for t in found.collect():
        mine[t.topic, t.word_id] = t.weight
    assert np.allclose(np.abs((mine * vectors[:12]).sum(1)), 1)


def test_leading_vectors_of_few_directions():
    r = np.random.default_rng(6)
    some = r.random((90, 7))
    values, vectors = topics.leading(lambda x: some @ (some.T @ x), 90, 12, 5, 15)
    assert np.allclose(values, np.linalg.eigvalsh(some @ some.T)[::-1][:12])
    assert np.allclose(vectors.T @ vectors, np.eye(12))


def test_lsi_of_more_words_than_fit_a_matrix(spark, monkeypatch):
    monkeypatch.setattr(topics, "BLOCK", 4, raising=False)
    monkeypatch.setattr(topics, "BEYOND", 12, raising=False)
    bows = spark.createDataFrame([([(0, 3.0)],), ([(20_500, 4.0)],)], "bow array<struct<idx:int,val:double>>")
    values, found = topics.lsi(bows, 20_501, 2)
    assert [round(v, 6) for v in values] == [4.0, 3.0]
    assert {(r.topic, r.word_id) for r in found.where("abs(weight) > 0.5").collect()} == {(0, 20_500), (1, 0)}


def test_projection(spark):
    weights = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.8), (2, "c", 1.0)], "doc_id int, term string, weight double")
    words = spark.createDataFrame([(0, "a", 1.0), (0, "b", -1.0), (1, "b", 0.5)], "topic int, word string, weight double")
    got = {(r.doc_id, r.topic): round(r.val, 9) for r in topics.project(weights, words).collect()}
    assert got == {(1, 0): -0.2, (1, 1): 0.4}


def test_projection_of_records_is_that_of_joins(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(7)
    rows = []
    for i in range(120):
        some = {f"s{int(k):02d}": int(n) for k, n in zip(r.integers(0, 90, 12) * r.integers(0, 2, 12), r.integers(1, 5, 12))}
        vec = [(int(t), float(v)) for t, v in zip(r.choice(40, 3, False), r.random(3) - 0.3)]
        rows.append((i, some if i % 10 else None, vec if i % 7 else None))
    rows.append((500, {"only": 1}, []))
    spark.createDataFrame(rows, "para_id bigint, counter map<string,bigint>, topic_vec array<struct<topic:int,val:double>>").write.parquet(f"{tmp_path}/para_stems.parquet")
    stems = spark.read.parquet(f"{tmp_path}/para_stems.parquet")
    words = topics.top_words(queries._weights(spark, str(tmp_path)).withColumn("weight", F.round("weight", 6)))
    weights = terms.tfidf(stems.select("para_id", F.explode("counter").alias("term", "cnt")), stems.where("counter is not null").count(), "para_id")
    vectors = topics.project(weights, words, "para_id").groupBy("para_id").agg(F.collect_list(F.struct("topic", F.round("val", 3).alias("val"))).alias("topic_vec"))
    expected = sorted(tuple(x) for x in topics.top_topics(vectors, "para_id").collect())
    shuffled = []
    monkeypatch.setattr(terms, "tfidf", lambda *a, was=terms.tfidf: shuffled.append(1) or was(*a))
    for held, often, most in ((1000, 0.05, 64 << 20), (1000, 0.5, 8 * 40 * 30), (1, 0.05, 1)):
        monkeypatch.setattr(topics, "HELD", most, raising=False)
        monkeypatch.setattr(queries, "HELD_TERMS", held, raising=False)
        monkeypatch.setattr(topics, "OFTEN", often, raising=False)
        assert sorted(tuple(x) for x in queries.QUERIES["project_topics"](spark, str(tmp_path)).collect()) == expected
        # entries of records are not shuffled unless there are too many terms
        assert len(shuffled) == (held == 1)


def test_lda_of_nothing(spark):
    none = spark.createDataFrame([], "k int, stem string, cnt bigint")
    assert topics.lda(none, none.selectExpr("stem", "1 as word_id"), "k").count() == 0


def test_topic_models_take_the_whole_vocabulary(spark, tmp_path):
    # 18 % of 100 stems: 18 words; a topic of 18 words lists each
    rows = [(i, {f"s{k:02d}": 1 + (i * k) % 7 for k in range(100) if k < 18 and (i + k) % 3 or k == i}) for i in range(100)]
    spark.createDataFrame(rows, "para_id int, counter map<string,bigint>").write.parquet(f"{tmp_path}/para_stems.parquet")
    lda, lsi = (queries.QUERIES[q](spark, str(tmp_path)).collect() for q in ("lda_topics", "lsi_topics"))
    assert len({r.word for r in lda}) == len({r.word for r in lsi}) == 18
    assert len({r.topic for r in lsi}) == 18


def test_lsi_topics_of_tfidf(spark, tmp_path):
    # a stem in every record weighs nothing by tf-idf, though it leads the raw counts
    rows = [(i, {"all": 50} | {f"s{(i + k) % 20:02d}": 1 for k in range(4)}) for i in range(40)]
    spark.createDataFrame(rows, "para_id int, counter map<string,bigint>").write.parquet(f"{tmp_path}/para_stems.parquet")
    first = {r.word: abs(r.weight) for r in queries.QUERIES["lsi_topics"](spark, str(tmp_path)).where("topic = 0").collect()}
    assert len(first) == 3 and first["all"] < 1e-9


def test_timer_and_report(spark):
    timer = reports.Timer()

    def work():
        with timer.stage("a"), timer.stage("b"):
            pass

    threads = [threading.Thread(target=work) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    with pytest.raises(KeyError), timer.stage("c"):
        raise KeyError
    got = {tuple(r.path): r for r in reports.timing_report(timer.table(spark)).collect()}
    assert set(got) == {("a",), ("a", "b"), ("c",)} and got["a",].n == 2 and got["c",].std == 0


def test_sinks_and_cut(spark, tmp_path):
    counts = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (2, "a b", 1)], "n int, term string, cnt bigint")
    sinks.write_phrase_counts(counts.coalesce(1), f"{tmp_path}/c")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/c").collect()) == ["1,a,b", "2,a", "2,b"]
    assert cut(counts).count() == 3
    hits = reports.search(spark.createDataFrame([("u", "x\nhack here\ny")], "url string, text string"), ["url"])
    head = spark.createDataFrame([("u", "ACME", 5, 2000, 1)], "url string, company_name string, cik int, year int, qtr int")
    assert reports.search_report(hits, head).first().line == "ACME (CIK 5) Y2000-Q1\nhack here"


def test_other_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2000, 1, "u", 3), (2000, 2, "v", 4)], "year int, qtr int, url string, n int")
    sinks.write_by_quarter(rows, f"{tmp_path}/q")
    assert spark.read.csv(f"{tmp_path}/q").where("year = 2000 and qtr = 2").first()[0] == "v"
    sinks.write_table(rows, f"{tmp_path}/t", ("year",))
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").select("url", "n", "qtr", "year").collect()) == [("u", 3, 1, 2000), ("v", 4, 2, 2000)]
    sinks.write_stem_report(terms.stem_report(spark.createDataFrame([("run", "runs", 2), ("run", "ran", 5)], "stem string, word string, cnt bigint")), f"{tmp_path}/s")
    assert spark.read.csv(f"{tmp_path}/s").first()[1] == "ran 5,runs 2"
    sinks.write_search(spark.createDataFrame([("p", "line")], "pattern string, line string"), f"{tmp_path}/h")
    assert spark.read.text(f"{tmp_path}/h").first().value == "line"


def test_term_list(spark, tmp_path):
    (tmp_path / "terms.csv").write_text("3,net,income\n\n9,risk\nx,tax,rate,change\n")
    got = [(r.term, r.cnt, r.word_id) for r in termlist.read_terms(spark, str(tmp_path / "terms.csv")).orderBy("word_id").collect()]
    assert got == [("net income", 3, 0), ("risk", 9, 1), ("tax rate change", None, 2)]


def test_small_operations(spark):
    df = spark.createDataFrame([("a", 2), ("a", -3), ("b", 4), ("c", 1), ("c", -1)], "k string, v int")
    assert [(r.k, r.v) for r in C.positive_sums(df, ["k"], "v").collect()] == [("b", 4)]
    assert C.sampled(df, 1.0, 0, 2).count() == 2 and C.sampled(df, 1.0).count() == 5 and C.sampled(df, 0.0).count() == 0
    assert [r.v for r in C.taken(df, 2, [F.col("v")]).collect()] == [-3, -1]
    assert C.zipped(df, df.select("k", F.lit(1).alias("w")).distinct(), ["k"]).count() == 5
    lists = spark.createDataFrame([([["a"], ["b", "c"]],)], "x array<array<string>>")
    assert lists.select(C.concat_lists(F.col("x"))).first()[0] == ["a", "b", "c"]
    assert result.good(spark.createDataFrame([(1, None), (2, "e")], "i int, error string")).count() == 1


def test_terms_of_all_levels(spark):
    text = "Blue Kettle sells lamps. The lamps shine"
    df = spark.createDataFrame([(1, 0, text), (1, 1, "Lamps"), (2, 0, None), (2, 1, "")], "doc int, para int, text string")
    fine = terms.all_terms(df, ["doc", "para"])
    whole = {(r.kind, r.n, r.term, r.word): r.cnt for r in terms.rolled_up(fine, []).collect()}
    assert whole == {(r.kind, r.n, r.term, r.word): r.cnt for r in terms.all_terms(df, []).collect()}
    assert whole["entity", None, "blue kettle", None] == 1 and whole["ngram", 0, "", None] == 7
    assert whole["ngram", 1, "lamp", None] == 3 and whole["ngram", 2, "lamp shine", None] == 1 and whole["stem", None, "lamp", "Lamps"] == 1
    assert terms.all_terms(df.limit(0), ["doc"]).count() == 0


def test_sections_from_submissions(spark):
    def submission(body, kind="10-K"):
        return f"<DOCUMENT>\n<TYPE>{kind}\n<TEXT>{body}</TEXT>\n</DOCUMENT>"

    good = "Part I\n\nItem 1A. Risk Factors\n\nfirst of them\n\nsecond of them\n\nItem 2. Properties"
    html = "<p>Item 7.</p><p>caf&#233;s are no ASCII</p><p>Item 8.</p>"
    cases = {"a": submission(good), "b": submission(good, "EX-1"), "c": submission(html), "d": submission("<p>Item 7.</p><p>tea &amp; cake</p><p>Item 8.</p>"), "f": None}
    filings = spark.createDataFrame([(u, "10-K", u in "cd") for u in "abcdef"], "url string, form_type string, early boolean")
    submissions = spark.createDataFrame(list(cases.items()), "url string, submission string")
    got = {r.url: (r.section, r.error.type if r.error else None) for r in sections.from_forms(filings, submissions, F.col("early")).collect()}
    assert got == {"a": (["first of them", "second of them"], None), "b": (None, "ParseError"), "c": (None, "AssertionError"), "d": (["tea & cake"], None), "e": (None, "ParseError"), "f": (None, "ParseError")}


def test_ranked_groups(spark):
    rows = [("x", 3), ("x", None), ("x", 1), (None, 5), (None, 4), ("y", 2), ("x", 1)]
    got = sorted((str(r.g), r["rank"], str(r.v)) for r in sections.ranked(spark.createDataFrame(rows, "g string, v int").repartition(3), "v", ["g"]).collect())
    assert got == sorted([("x", 1, "None"), ("x", 2, "1"), ("x", 3, "1"), ("x", 4, "3"), ("None", 1, "4"), ("None", 2, "5"), ("y", 1, "2")])


def test_memory_in_the_timing_report(spark):
    samples = spark.createDataFrame([(["a"], 1.0, 10), (["a"], 3.0, 30), (["a", "b"], 1.0, 5)], "path array<string>, duration double, used int")
    got = {tuple(r.path): (r.memory_mean, round(r.memory_std, 3)) for r in reports.timing_report(samples, "used").collect()}
    assert got == {("a",): (20.0, 14.142), ("a", "b"): (5.0, 0.0)}
