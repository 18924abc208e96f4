import numpy as np
import pytest

from filigree.llm.packing import Packer, pack, pack_shard, packing_report, token_counts

SPECS = "spec_id int, capacity_tokens int"


def check(sizes, capacity):
    row, piece, tokens, box, fill = pack_shard(np.array(sizes, np.int64), capacity)
    assert np.bincount(row, weights=tokens, minlength=len(sizes)).astype(int).tolist() == list(sizes)
    for i, s in enumerate(sizes):
        n = (row == i).sum()
        assert n == 1 if 0 < s <= capacity else n == -(-s // capacity)
    for b in np.unique(box):
        mine = np.flatnonzero(box == b)
        order = mine[np.argsort(fill[mine])]
        assert fill[order].tolist() == np.concatenate([[0], np.cumsum(tokens[order])[:-1]]).astype(int).tolist()
        assert tokens[order].sum() <= capacity
    return len(np.unique(box))


def test_places_are_whole():
    r = np.random.default_rng(1)
    for capacity in (1, 2, 7, 64):
        for n in (0, 1, 5, 300):
            check(r.integers(1, 100, n).tolist(), capacity)


def test_little_space_is_left():
    sizes = np.random.default_rng(2).integers(1, 200, 5000)
    assert sizes.sum() / (check(sizes.tolist(), 256) * 256) > 0.98


def test_choice_minimises_the_squares():
    r = np.random.default_rng(4)
    p = Packer(10)
    levels: list[int] = []
    for size in r.integers(1, 11, 300).tolist():
        counts = np.bincount(levels, minlength=11)
        options = {}
        for level in {0, *levels}:
            if level + size <= 10 and (level == 0 or level < 10):
                after = counts.copy()
                after[level] -= level > 0
                after[level + size] += 1
                options[level] = (after[1:10] ** 2).sum()
        box, level = p.place(size)
        assert options[level] == min(options.values())
        if level:
            levels.remove(level)
        levels.append(level + size)


def test_pack(spark):
    texts = [(1, "hello world"), (2, None), (3, ""), (4, "word " * 3000), (5, "hello world"), (5, "hello world")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "2 as spec_id", "3 as key")
    specs = spark.createDataFrame([(1, 16), (2, 100000)], SPECS)
    sizes = sorted((r.doc_id, r.n_tokens) for r in token_counts(df).collect())
    assert [k for k, _ in sizes] == [1, 4, 5, 5]
    got = pack(df, specs).collect()
    for spec, capacity in ((1, 16), (2, 100000)):
        mine = [r for r in got if r.spec_id == spec]
        assert sum(r.tokens for r in mine) == sum(n for _, n in sizes)
        used = {}
        for r in mine:
            used[r.container_id] = used.get(r.container_id, 0) + r.tokens
        assert max(used.values()) <= capacity
    report = {r.spec_id: r for r in packing_report(pack(df, specs), specs).collect()}
    assert report[1].texts == 4 and report[2].containers == 1
    assert pack(df.limit(0), specs).count() == 0 and pack(df, specs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(df, spark.createDataFrame([(1, 0)], SPECS))
