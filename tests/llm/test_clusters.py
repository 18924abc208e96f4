import math
import random

import pytest

from filigree.llm.clusters import assign, centroids, clustered, components, typical_members

ROWS = "para_id bigint, topic_vec array<struct<topic:int,val:double>>, size int, n int, key int"


def unit(v):
    flat = {}
    for t, x in v:
        flat[t] = flat.get(t, 0.0) + x
    most = max(map(abs, flat.values()), default=0.0)
    flat = {t: x / most for t, x in flat.items()} if most else {}
    norm = math.sqrt(sum(x * x for x in flat.values()))
    return {t: x / norm for t, x in flat.items()} if norm else {}


def rows_of(seed, clusters=30, alone=60):
    r = random.Random(seed)
    out = []
    for c in range(clusters):
        topics = r.sample(range(500), 9)
        for _ in range(1 + c % 12):
            scale = 10 ** r.uniform(-3, 3)
            v = [(t, scale * r.uniform(0.8, 1.2)) for t in topics] + [(r.randrange(500), scale * r.uniform(-0.05, 0.05))]
            r.shuffle(v)
            out.append(v)
    out += [[(t, r.uniform(-1, 1)) for t in r.sample(range(500), 8)] for _ in range(alone)]
    out += [[(7, 1.0)], [(7, 1e-200)], [(7, 3.0), (7, 2.0)], [(7, -1.0)], [], None, [(3, 0.0)], out[0]]
    r.shuffle(out)
    return [(i, v, 1, 2, 3) for i, v in enumerate(out)]


def brute(rows, least=3):
    real = [(i, u) for i, v, *_ in rows if v and (u := unit(v))]
    out = {}
    for i, a in real:
        near = [j for j, b in real if sum(x * b.get(t, 0.0) for t, x in a.items()) >= 0.7]
        if len(near) >= least:
            out[i] = (min(near), len(near))
    return out


def test_against_every_pair(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = {r.para_id: (r.cluster_id, r.size) for r in clustered(df).collect()}
    assert got == brute(rows)


def test_blocks_of_centroids(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {r.para_id: (r.cluster_id, r.size) for r in assign(df, centroids(df), block_entries=40).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("settings", [{"rounds": 0}, {"rounds": 0, "keyed": 4}, {"keyed": 2}])
def test_large_keys_in_blocks(spark, settings):
    # most rows are single ones and share a topic pair, so its key is that of many leaves
    r = random.Random(9)
    rows = [(i, [(1, 0.3), (2, 0.3)] + [(t, r.uniform(-1, 1)) for t in r.sample(range(10, 500), 6)], 1, 2, 3) for i in range(300)]
    rows += [(300 + i, v, *rest) for i, v, *rest in rows_of(4, 8, 0)]
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    got = {r.para_id: (r.cluster_id, r.size) for r in assign(df, centroids(df, **settings)).collect()}
    assert got == brute(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (100, 102), (200, 201)]
    random.Random(1).shuffle(chain)
    got = {r.leaf: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 102)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_blocks_agree_where_similarity_is_not_transitive(spark):
    # vectors on an arc: each is like its neighbours, the ends are not like each other
    rows = [(i, [(1, math.cos(a)), (2, math.sin(a))], 1, 2, 3) for i, a in enumerate(k * math.pi / 60 for k in range(30))] + [(0, [(1, 1.0), (2, 0.0)], 1, 2, 3)]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    found = centroids(df, rounds=0)
    one, many = (sorted((r.para_id, r.cluster_id) for r in assign(df, found, block_entries=n).collect()) for n in (1000, 1))
    assert one == many and len(one) == 31


def test_one_topic_against_two_across_partitions(spark):
    # cosine 0.705 by one shared topic, of weights 1 and 0.705; no rounds, so that only the keys bring them together
    vec = "if(id = 1, array(struct(1 as topic, 1D as val)), array(struct(1 as topic, 0.705D as val), struct(2 as topic, 0.709D as val))) as topic_vec"
    df = spark.range(1, 3, numPartitions=2).selectExpr("id as para_id", vec)
    assert df.rdd.getNumPartitions() == 2
    assert [(r.n, r.least) for r in centroids(df, rounds=0).collect()] == [(2, 1)]


def test_typical_members(spark):
    df = spark.createDataFrame(rows_of(5), ROWS)
    got = typical_members(clustered(df), 2).collect()
    assert {r["rank"] for r in got} == {1, 2} and all(0.7 <= r.typicality <= 1 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert clustered(df).count() == 0
    assert clustered(spark.createDataFrame([(1, None, 0, 0, 0), (2, [], 0, 0, 0)], ROWS)).count() == 0
