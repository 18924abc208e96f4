import random

from filigree.llm.leakage import consistent, facts, fold, leaks, words_of
from filigree.llm.lookalike import Canon


def found(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item", "'x' as verbatim")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "0 as doc_id")
    return {(r.doc_id, r.item_id, r.verbatim): r.windows for r in leaks(d, i, **settings).collect()}


def brute(docs, items, width=15):
    canon = Canon()
    split = lambda t: [fold(w) for w in words_of(canon.text(t or ""))]
    runs = {k: {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} for k, w in ((k, split(t)) for k, t in items)}
    out = {}
    for k, t in docs:
        w = split(t)
        mine = [tuple(w[j : j + width]) for j in range(len(w) - width + 1)]
        for item, r in runs.items():
            n = sum(x in r for x in mine)
            if n:
                out[k, item, True] = n
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["12", "million", "Ostmar", "Beldale", "été", "год"]
    items = [(i, " ".join(r.choices(words, k=r.choice((3, 14, 15, 30))))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for k in range(200):
        body = r.choices(words, k=r.randint(0, 60))
        if k % 2:
            source = r.choice(items[:30])[1].split()
            n, at = r.randint(10, 30), r.randint(0, 5)
            body[5:5] = source[at : at + n]
        text = r.choice((" ", ", ", "\n", " ")).join(body)
        docs.append((k, text.upper() if k % 5 == 0 else text.replace("w1", "ｗ1") if k % 7 == 0 else text))
    docs += [(900, None), (901, ""), (902, "x " * 20000 + items[3][1])]
    want = brute(docs, items)
    assert want
    assert found(spark, docs, items) == want


def test_reparametrised(spark):
    item = "During 2011 Corilberg Insurance chose to waive federal penalties while it paid 12 million to senior lenders of Corilberg Insurance and then closed"
    same = item.replace("2011", "1999").replace("Corilberg", "Zanodale").replace("12", "77")
    mixed = same.replace("of Zanodale", "of Otherdale")
    got = found(spark, [(1, item), (2, same), (3, mixed)], [(7, item)], reparametrised=True, width=21)
    assert (1, 7, True) in got and (2, 7, False) in got and (2, 7, True) not in got
    assert (3, 7, False) not in got


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a " * 20)]) == {} and found(spark, [(1, "a " * 20)], []) == {}


def planted(seed=11, count=40):
    """Items, documents with a consistent exchange of slots, and documents with an inconsistent one or with other words."""
    r = random.Random(seed)
    verbs, nouns = [f"verb{chr(97 + i)}" for i in range(20)], [f"noun{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(6)]
    names = ["Corilberg", "Zanodale", "Ulmindyne", "Bexford", "Haliport", "Nevicor", "Tarlomont", "Wiloham"]
    units = ["million", "percent", "tonnes", "euros"]
    items, renamed, others = [], [], []
    for i in range(count):
        a, b = r.sample(names, 2)
        n, u = r.randint(10, 99), r.choice(units)
        v, w = r.sample(nouns, 6), r.sample(verbs, 3)
        shape = f"In {{y}} the {v[0]} of {{a}} {w[0]} {{n}} {{u}} for {v[1]} and {v[2]} while {{b}} {w[1]} the {v[3]} of {{c}} and {w[2]} {v[4]} near {v[5]}"
        item = shape.format(y=2001 + i % 9, a=a, b=b, c=a, n=n, u=u)
        c, d = (f"New{x}name" for x in r.sample("abcdefgh", 2))
        items.append((i, item + ". Some more of it follows here"))
        renamed.append((1000 + i, shape.format(y=1990, a=c, b=d, c=c, n=n + 100, u=r.choice([x for x in units if x != u]))))
        others.append((2000 + i, shape.format(y=1990, a=c, b=d, c=d, n=n, u=u)))
        others.append((3000 + i, item.replace(v[1], "else").replace(v[2], "other").replace(v[3], "thing").replace(v[0], "again")))
    return items, renamed, others


def test_planted_reparametrised_items(spark):
    items, renamed, others = planted()
    got = {(d, i) for d, i, verbatim in found(spark, [(d, "Before that. " + t + " and so on.") for d, t in renamed + others], items, reparametrised=True, width=20) if not verbatim}
    want = {(1000 + i, i) for i, _ in items}
    recall, precision = len(got & want) / len(want), len(got & want) / max(len(got), 1)
    print("recall", recall, "precision", precision)
    assert recall >= 0.9 and precision >= 0.9


def test_kinds_follow_from_all_items(spark):
    # a name in one item is known as such in every other; capitals of a text that writes its nouns so name nothing
    english = facts("The board of Ostmar met. Ostmar paid 12 million euros in 2010 and 3 million more")
    assert english["ostmar"][2] == 1 and english["million"][3] == 2 and english["board"][1] == 1
    german = facts("Die Gesellschaft hat im Jahr den Umsatz der Gruppe mit Erfolg gesteigert")
    assert german["umsatz"][2] == 0
    assert consistent("a x b x", "a y b y", "4242") and not consistent("a x b x", "a y b z", "4242") and not consistent("a x b z", "a y b y", "4242")
