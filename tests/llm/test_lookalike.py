import pytest

from filigree.llm.lookalike import Canon, Trie, canonical_texts, look_groups, look_pairs, skeleton, store_vocabulary, stored_vocabulary, vocabulary

SAME = [
    ("redundant", "rеdunԁant"),
    ("redundant", "re​dundant"),
    ("tariffs", "tariﬀs"),
    ("or,", "ｏｒ，"),
    ("Malmö", "Malmö"),
    ("Kelvin", "Kelvin"),
    ("long-dated", "long‑dated"),
    ("a b", "a b"),
    ("a b", "a b"),
    ("Some", "Ѕοme"),
    ("нет", "нeт"),
    ("é", "е́"),
    ("a\nb", "a\r\nb"),
]
DIFFERENT = [("résumé", "resume"), ("Change", "change"), ("10", "1O"), ("x2", "x²"), ("a b", "a  b"), ("a\nb", "a b"), ("£5", "$5"), ("a–b", "a-b"), ("a;b", "a,b"), ("a\tb", "a b"), ("соль", "соли")]


@pytest.mark.parametrize("words", [(), ("redundant", "нет", "tariffs", "Malmö")])
def test_forms(words):
    canon = Canon(words)
    for a, b in SAME:
        assert canon.text(a) == canon.text(b), (a, b)
    for a, b in DIFFERENT:
        assert canon.text(a) != canon.text(b), (a, b)
    for a, b in SAME + DIFFERENT:
        assert canon.text(canon.text(b)) == canon.text(b)


def test_trie_walks_at_no_cost():
    trie = Trie(["redundant", "нет", "tariffs", "été"])
    walk = lambda word: (trie.walk(word) or (None, None))[1]
    assert walk("rеdundаnt") == "redundant" and walk("re​dundant") == "redundant"
    assert walk("tariﬀs") == "tariffs" and walk("нeт") == "нет" and walk("été") == "été"
    assert walk("redundan") is None and walk("ete") is None and walk("") is None
    assert skeleton("сор") == "cop"


def test_trie_weighs_changes():
    trie = Trie(["année", "annexe", "Test"])
    assert trie.walk("annee") is None and trie.walk("annee", 1.0) == (1.0, "année")
    assert trie.walk("аnnéе", 1.0) == (0.0, "année") and trie.walk("test", 1.0) == (1.0, "Test")
    assert trie.walk("tést", 1.0) is None and trie.walk("tést", 2.0) == (2.0, "Test")
    assert trie.walk("annex", 2.0) == (2.0, "annexe") and trie.walk("annexxe", 2.0) == (2.0, "annexe")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_pairs_against_every_pair(spark):
    texts = [x for pair in SAME + DIFFERENT for x in pair] + ["redundant", "rеdunԁant", None, "", "​", "﻿", "long " * 5000 + "é", "long " * 5000 + "é"]
    df = frame(spark, texts)
    canon = vocabulary(df, min_count=1)
    forms = [None if not t else canon.text(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if forms[i] is not None and forms[i] == forms[j] and texts[i] != texts[j]}
    got = {tuple(r) for r in look_pairs(df).collect()}
    assert got == want and got


def test_empty_null_and_clashing(spark):
    df = frame(spark, [None, "", "a"]).selectExpr("doc_id", "text", "1 as form", "2 as key", "3 as raw")
    assert look_pairs(df).count() == 0 and look_groups(df).count() == 0
    assert look_pairs(df.limit(0)).count() == 0
    assert {r.doc_id: r.form for r in canonical_texts(df).collect()} == {0: None, 1: "", 2: "a"}


def test_vocabulary_spells_the_form(spark):
    df = frame(spark, ["год год год года", "гoд сoр"])
    canon = vocabulary(df)
    assert canon.text("гoд") == "год" and canon.text("сoр") == "cop"


def test_the_trie_decides_the_script(spark, tmp_path):
    # all letters of the Russian heading have Latin look-alikes: only the vocabulary knows how it is spelt
    df = frame(spark, ["РОСТ РОСТ ТЕСТ РОСТ ТЕСТ ТЕСТ", "PОCT", "POCT", "CAT CAT CAT", "САТ", "a b c", "с"])
    canon = vocabulary(df)
    assert canon.text("PОCT") == canon.text("POCT") == "РОСТ" and Canon().text("РОСТ") == "POCT"
    assert canon.text("САТ") == "CAT" and canon.text("с") == "c"
    forms = {r.doc_id: r.form for r in canonical_texts(df).collect()}
    assert forms[1] == forms[2] == "РОСТ" and forms[0] == "РОСТ РОСТ ТЕСТ РОСТ ТЕСТ ТЕСТ"
    assert {tuple(r) for r in look_pairs(df).collect()} == {(1, 2)}
    # a stored vocabulary gives the same forms for another corpus
    version = store_vocabulary(spark, canon, str(tmp_path))
    again = stored_vocabulary(spark, str(tmp_path), version)
    assert again.version == version and again.text("POCT") == "РОСТ"
    more = frame(spark, ["POCT " * 100])
    assert canonical_texts(more, canon=again).first().form.startswith("РОСТ") and canonical_texts(more).first().form.startswith("POCT")
