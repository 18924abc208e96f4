"""Records in clusters of mutually similar vectors.

Method: every task builds a cluster-feature tree of its rows: leaf entries hold
number, linear sum and smallest key of the unit vectors absorbed; inner nodes are
the topics by which entries are found. Leaf entries are merged in rounds of a
reduction (features add up), what is left is linked over pairs of topics, each
connected component of links is agglomerated by Ward's criterion, and a last pass
assigns every row to its cluster's centroid.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.store import cut, discard

COSINE = 0.7
#: Rows whose vectors are compared with the tree at once.
BATCH = 2048
#: Rounds of merging by one key before leaves are linked.
ROUNDS = 2
#: Leaves that one task of a round merges, in the mean.
MERGED = 8_000
#: Norm of a leaf's vector that may be left out of its keys; see _pair_keys.
TAIL = 0.1
#: Norm of a mean that the inner level of the tree may leave out; products found there are checked exactly.
PRUNED = 0.05
#: Entries of centroid vectors held by one task; more centroids take more passes.
BLOCK_ENTRIES = 4_000_000
#: Cells in which the leaves of each key are counted, and the leaves of one key that a task compares at once.
KEY_CELLS, KEYED = 1 << 16, 4096
EPS = 1e-9


class Sparse:
    """Rows of (topic, value), in compressed form."""

    def __init__(self, indptr: np.ndarray, topics: np.ndarray, values: np.ndarray) -> None:
        self.indptr, self.topics, self.values = indptr, topics, values

    def __len__(self) -> int:
        return len(self.indptr) - 1

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.indptr))

    def take(self, at: np.ndarray) -> Sparse:
        sizes = np.diff(self.indptr)[at]
        indptr = np.concatenate([[0], np.cumsum(sizes)])
        src = np.repeat(self.indptr[at] - indptr[:-1], sizes) + np.arange(indptr[-1])
        return Sparse(indptr, self.topics[src], self.values[src])


def _sums(rows: np.ndarray, topics: np.ndarray, values: np.ndarray, n: int) -> Sparse:
    """Rows with each topic once, values of repeated topics added, zeros dropped."""
    if not len(rows):
        return Sparse(np.zeros(n + 1, np.int64), np.empty(0, np.int64), np.empty(0))
    order = np.lexsort((topics, rows))
    r, t, v = rows[order], topics[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])]))
    v = np.add.reduceat(v, first)
    r, t = r[first], t[first]
    keep = v != 0
    r, t, v = r[keep], t[keep], v[keep]
    return Sparse(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]), t, v)


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, Sparse]:
    """(rows, unit vectors) of array<struct<topic, val>>; rows without a vector of positive finite length are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    topics = pc.fill_null(pc.struct_field(flat, 0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(pc.struct_field(flat, 1), 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    values[~np.isfinite(values)] = 0.0
    rows = np.repeat(np.arange(len(column)), lengths)
    # largest entry first to 1: very long and very short vectors keep their direction
    most = np.zeros(len(column))
    np.maximum.at(most, rows, np.abs(values))
    values = np.divide(values, most[rows], out=np.zeros_like(values), where=most[rows] > 0)
    all_rows = _sums(rows, topics, values, len(column))
    norms = np.sqrt(np.bincount(all_rows.rows, weights=all_rows.values**2, minlength=len(column)))
    kept = np.flatnonzero(norms > 0)
    out = all_rows.take(kept)
    out.values = out.values / np.repeat(norms[kept], np.diff(out.indptr))
    return kept, out


def pruned(means: Sparse, tail: float = PRUNED) -> tuple[Sparse, np.ndarray]:
    """(means without their weakest topics, norm left out of each), the latter at most `tail`."""
    n, rows = len(means), means.rows
    order = np.lexsort((np.abs(means.values), rows))
    squares = np.cumsum(means.values[order] ** 2)
    before = np.concatenate([[0.0], squares])[means.indptr[:-1]]
    lost = squares - before[rows]
    gone = lost <= tail * tail
    norm = np.zeros(n)
    np.maximum.at(norm, rows[gone], np.sqrt(np.maximum(lost[gone], 0)))
    keep = np.zeros(len(rows), bool)
    keep[order[~gone]] = True
    return Sparse(np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=n))]), means.topics[keep], means.values[keep]), norm


def dots(a: Sparse, i: np.ndarray, b: Sparse, j: np.ndarray) -> np.ndarray:
    """Exact dot products of rows i of a with rows j of b; topics stand in order within rows of b."""
    part = a.take(i)
    pair = part.rows
    keys = b.rows * (1 << 31) + b.topics
    asked = j[pair] * (1 << 31) + part.topics
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    hit = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
    return np.bincount(pair[hit], weights=part.values[hit] * b.values[at[hit]], minlength=len(i))


class Index:
    """Inner level of the tree: for each topic the entries whose means have it among their stronger ones."""

    def __init__(self, means: Sparse) -> None:
        self.means = means
        strong, self.tails = pruned(means)
        order = np.argsort(strong.topics, kind="stable")
        self.topics, self.owners, self.values = strong.topics[order], strong.rows[order], strong.values[order]
        self.count = len(means)
        top = int(self.topics[-1]) + 1 if len(self.topics) else 0
        self.starts = np.searchsorted(self.topics, np.arange(top + 1))

    def best(self, vectors: Sparse, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """For each vector (entry, product) of the mean with the largest product of at least `cosine`; entry -1 if there is none."""
        n = len(vectors)
        entry, dot = np.full(n, -1), np.full(n, -np.inf)
        for r, e, v in self.similar(vectors, cosine):
            order = np.lexsort((e, -v, r))
            r, e, v = r[order], e[order], v[order]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else r
            entry[r[first]], dot[r[first]] = e[first], v[first]
        return entry, dot

    def similar(self, vectors: Sparse, cosine: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, entry, product) for all products of at least `cosine`, some rows at a time.

        vectors have at most length one, so what the means leave out lowers a
        product by no more than its norm; what may reach the bound is multiplied out.
        """
        if not self.count or not len(self.topics):
            return
        step = max(1, min(step, 8_000_000 // self.count))
        least = np.tile((cosine - EPS - 1e-6 - self.tails).astype(np.float32), step)
        for at in range(0, len(vectors), step):
            part = vectors.take(np.arange(at, min(at + step, len(vectors))))
            known = part.topics < len(self.starts) - 1
            topics = np.where(known, part.topics, 0)
            starts = self.starts[topics]
            sizes = np.where(known, self.starts[topics + 1] - starts, 0)
            src = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            flat = np.bincount(np.repeat(part.rows * self.count, sizes) + self.owners[src], weights=np.repeat(part.values, sizes) * self.values[src], minlength=len(part) * self.count)
            hit = np.flatnonzero(flat >= least[: len(flat)])
            r, e = hit // self.count, hit % self.count
            v = dots(part, r, self.means, e)
            keep = v >= cosine - EPS
            yield r[keep] + at, e[keep], v[keep]


class Leaves:
    """Leaf entries: number, linear sum of unit vectors, smallest key."""

    def __init__(self, n: np.ndarray, sums: Sparse, least: np.ndarray) -> None:
        self.n, self.sums, self.least = n, sums, least

    def __len__(self) -> int:
        return len(self.n)

    def means(self) -> Sparse:
        return Sparse(self.sums.indptr, self.sums.topics, self.sums.values / np.repeat(self.n, np.diff(self.sums.indptr)))

    def merged(self, label: np.ndarray, count: int) -> Leaves:
        """Entries of the same label as one: all three features add up."""
        n = np.bincount(label, weights=self.n, minlength=count).astype(np.int64)
        least = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(least, label, self.least)
        return Leaves(n, _sums(label[self.sums.rows], self.sums.topics, self.sums.values, count), least)

    def joined(self, other: Leaves) -> Leaves:
        sums = Sparse(np.concatenate([self.sums.indptr, other.sums.indptr[1:] + self.sums.indptr[-1]]), np.concatenate([self.sums.topics, other.sums.topics]), np.concatenate([self.sums.values, other.sums.values]))
        return Leaves(np.concatenate([self.n, other.n]), sums, np.concatenate([self.least, other.least]))


def ward(leaves: Leaves, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Labels of leaves agglomerated along links (a, b), cheapest increase of variance first.

    Two clusters merge if the mean similarity of their members, which their sums
    give exactly, reaches the threshold.
    """
    k = len(leaves)
    part = {i: dict(zip(leaves.sums.topics[s:e].tolist(), leaves.sums.values[s:e].tolist())) for i, (s, e) in ((i, leaves.sums.indptr[i : i + 2]) for i in np.unique(np.concatenate([a, b])).tolist())}
    n, parent, near = leaves.n.astype(float).tolist(), list(range(k)), {}
    for x, y in zip(a.tolist(), b.tolist()):
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)

    def link(x: int, y: int) -> tuple[float, int, int] | None:
        small, large = sorted((part[x], part[y]), key=len)
        dot = sum(v * large.get(t, 0.0) for t, v in small.items()) / n[x] / n[y]
        if dot < cosine - EPS:
            return None
        square = sum(v * v for v in part[x].values()) / n[x] ** 2 + sum(v * v for v in part[y].values()) / n[y] ** 2 - 2 * dot
        return n[x] * n[y] / (n[x] + n[y]) * max(square, 0.0), min(x, y), max(x, y)

    version = [0] * k
    heap = [(*w, 0, 0) for x, y in zip(a.tolist(), b.tolist()) if x < y and (w := link(x, y))]
    heapq.heapify(heap)
    while heap:
        _, x, y, vx, vy = heapq.heappop(heap)
        if parent[x] != x or parent[y] != y or version[x] != vx or version[y] != vy:
            continue
        parent[y] = x
        for t, v in part.pop(y).items():
            part[x][t] = part[x].get(t, 0.0) + v
        n[x] += n[y]
        version[x] += 1
        near[x] = {z for z in near[x] | near.pop(y) if z not in (x, y)}
        for z in near[x]:
            near[z].discard(y)
            near[z].add(x)
            if w := link(x, z):
                heapq.heappush(heap, (*w, version[w[1]], version[w[2]]))
    for i in range(k):
        at = i
        while parent[at] != at:
            at = parent[at]
        parent[i] = at
    return np.array(parent)


def condense(leaves: Leaves, cosine: float) -> Leaves:
    """Leaves of one task merged where they are similar."""
    means = leaves.means()
    found = [(r, e) for r, e, _ in Index(means).similar(means, cosine)]
    a, b = np.concatenate([f[0] for f in found] or [np.empty(0, int)]), np.concatenate([f[1] for f in found] or [np.empty(0, int)])
    keep = a < b
    if not keep.any():
        return leaves
    label = ward(leaves, a[keep], b[keep], cosine)
    names, label = np.unique(label, return_inverse=True)
    return leaves.merged(label, len(names))


class Tree:
    """Cluster-feature tree of the rows of one task."""

    def __init__(self, cosine: float) -> None:
        self.cosine = cosine
        self.leaves: Leaves | None = None
        self.index: Index | None = None

    def insert(self, vectors: Sparse, keys: np.ndarray) -> None:
        """Rows go to the entry they are similar to in the mean; the rest make entries of their own."""
        fresh = Leaves(np.ones(len(vectors), np.int64), vectors, keys)
        if self.leaves is None:
            self.leaves = condense(fresh, self.cosine)
        else:
            entry, _ = self.index.best(vectors, self.cosine)
            home = entry >= 0
            rest = np.flatnonzero(~home)
            new = condense(Leaves(fresh.n[rest], vectors.take(rest), keys[rest]), self.cosine) if len(rest) else None
            k = len(self.leaves)
            mine = np.flatnonzero(home)
            both = self.leaves.joined(Leaves(fresh.n[mine], vectors.take(mine), keys[mine]))
            self.leaves = both.merged(np.concatenate([np.arange(k), entry[mine]]), k)
            if new is not None:
                self.leaves = self.leaves.joined(new)
        self.index = Index(self.leaves.means())


_LEAF = "n bigint, least bigint, topics array<int>, vals array<double>"


def _emit(leaves: Leaves) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(leaves), 8192):
        end = min(at + 8192, len(leaves))
        s = leaves.sums.take(np.arange(at, end))
        offsets = pa.array(s.indptr.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(leaves.n[at:end]), pa.array(leaves.least[at:end]), pa.ListArray.from_arrays(offsets, pa.array(s.topics.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(s.values))], names=["n", "least", "topics", "vals"]
        )


def _read(batches: list[pa.RecordBatch]) -> Leaves:
    table = pa.Table.from_batches(batches).combine_chunks()
    lists = table["topics"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    sums = Sparse(np.concatenate([[0], np.cumsum(sizes)]), pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(table["vals"].combine_chunks()).to_numpy(zero_copy_only=False))
    return Leaves(table["n"].to_numpy(), sums, table["least"].to_numpy())


def _build(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(cosine)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows, vectors = unit_vectors(part.column(1))
                if len(rows):
                    tree.insert(vectors, part.column(0).to_numpy(zero_copy_only=False)[rows])
        if tree.leaves is not None:
            yield from _emit(tree.leaves)

    return run


def _reduce(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held and sum(b.num_rows for b in held):
            yield from _emit(condense(_read(held), cosine))

    return run


def _mean_entries() -> Column:
    return F.arrays_zip(F.col("topics").alias("t"), F.transform("vals", lambda v: v / F.col("n")).alias("v"))


def _round_key(seed: int) -> Column:
    """One key for a leaf: of its eight strongest topics the two that come first in an order by hash."""
    entries = F.arrays_zip(F.col("topics").alias("t"), F.col("vals").alias("v"))
    strong = F.slice(F.array_sort(F.transform(entries, lambda e: F.struct((-F.abs(e["v"])).alias("a"), e["t"].alias("t")))), 1, 8)
    mixed = F.array_sort(F.transform(strong, lambda e: F.struct(F.xxhash64(e["t"], F.lit(seed)).alias("h"))))
    return F.xxhash64(F.slice(mixed, 1, 2), F.lit(seed))


def _keys_of(means: Sparse, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) such that means similar by `cosine` share a key.

    Of a mean the strongest topics are taken until at most TAIL of its norm is left.
    Keys are all pairs of them and single topics of a weight of at least
    cosine - 2 * TAIL, as the other weight may be 1. Two means that share no such
    key have at most one of the taken topics in common, with a product below that
    bound, and the rest of the dot product is at most 2 * TAIL: they are not similar.
    """
    single = cosine - 2 * TAIL
    keys, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(len(means)):
        s, e = means.indptr[i : i + 2]
        t, v = means.topics[s:e], np.abs(means.values[s:e])
        order = np.argsort(-v, kind="stable")
        tails = np.sqrt(np.maximum(np.cumsum((v[order] ** 2)[::-1])[::-1], 0))
        t = np.sort(t[order[tails > TAIL]])
        x, y = np.triu_indices(len(t), 1)
        mine = np.concatenate([t[x] * 1_000_003 + t[y] + (1 << 40), means.topics[s:e][v >= single - EPS]])
        keys.append(mine)
        owner.append(np.full(len(mine), i))
    return np.concatenate(owner), np.concatenate(keys)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cell(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys) & np.uint64(KEY_CELLS - 1)).astype(np.int64)


def _count_keys(cosine: float):
    """One row a task: packed numbers of leaves in each cell of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(KEY_CELLS, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount(_cell(_keys_of(_read([batch]).means(), cosine)[1]), minlength=KEY_CELLS)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["cells"])

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(KEY_CELLS, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            counts += np.frombuffer(zlib.decompress(blob), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["cells"])


def _pair_keys(cosine: float, shared, keyed: int):
    """(key, leaf) rows for leaves that may meet another by a key.

    A key of many leaves is cut into blocks: each leaf goes to the pairs of blocks
    that its own is part of, so no task holds more of a key than two blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = _read([batch])
            owner, key = _keys_of(leaves.means(), cosine)
            number = counts[_cell(key)]
            met = number > 1
            owner, key, number = owner[met], key[met], number[met]
            blocks = np.maximum(1, -(-2 * number // keyed)) * (number > keyed) + (number <= keyed)
            own = (_mix(leaves.least[owner] + 7) % blocks.astype(np.uint64)).astype(np.int64)
            rows = np.repeat(np.arange(len(key)), blocks)
            other = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            low, high = np.minimum(own[rows], other), np.maximum(own[rows], other)
            split = blocks[rows] > 1
            name = np.where(split, _mix(_mix(key[rows]).view(np.int64) + low * 1_000_003 + high).view(np.int64), key[rows])
            at = pa.array(owner[rows])
            out = [pa.array(name), *(batch[k].take(at) for k in ("n", "least", "topics", "vals"))]
            for i in range(0, len(name), 16_384):
                yield pa.RecordBatch.from_arrays([c.slice(i, 16_384) for c in out], names=["key", "n", "least", "topics", "vals"])

    return run


def _links(cosine: float):
    """(a, b) of leaves (by smallest key) that share a key and are similar; rows come sorted by key."""

    def settle(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        keys = table["key"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        several = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(several):
            return
        table = table.take(pa.array(several)).combine_chunks()
        leaves = _read(table.select(["n", "least", "topics", "vals"]).to_batches())
        means, keys = leaves.means(), table["key"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        found = []
        # small groups all at once, each row with the k-th after it; large ones by their topics
        small = np.repeat(sizes <= 128, sizes)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(keys)) - 1
        at, k = np.flatnonzero(small & (left > 0)), 1
        while len(at):
            for part in np.array_split(at, -(-len(at) // 50_000)):
                hit = part[dots(means, part, means, part + k) >= cosine - EPS]
                if len(hit):
                    found.append(np.stack([leaves.least[hit], leaves.least[hit + k]]))
            k += 1
            at = at[left[at] >= k]
        for s, n in zip(starts[sizes > 128].tolist(), sizes[sizes > 128].tolist()):
            mine = means.take(np.arange(s, s + n))
            for r, c, _ in Index(mine).similar(mine, cosine):
                hit = r < c
                if hit.any():
                    found.append(np.stack([leaves.least[s + r[hit]], leaves.least[s + c[hit]]]))
        if found:
            both = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch["key"].to_numpy()
            if rows >= 20_000 and (first := int(np.searchsorted(keys, keys[0], side="right"))) and held[-1]["key"][-1].as_py() != keys[0]:
                yield from settle(held)
                held, rows = [], 0
            cut_at = int(np.searchsorted(keys, keys[-1]))
            if rows + cut_at >= 20_000 and cut_at:
                yield from settle([*held, batch.slice(0, cut_at)])
                held, rows = [batch.slice(cut_at)], batch.num_rows - cut_at
            else:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield from settle(held)

    return run


def centroids(rows: DataFrame, cosine: float = COSINE, key: str = "para_id", column: str = "topic_vec", rounds: int = ROUNDS, keyed: int = KEYED) -> DataFrame:
    """(n, least, topics, vals): for every cluster its size, smallest key and the sum of its unit vectors.

    All rows with a vector are counted in exactly one cluster, those alone too.
    """
    leaves = cut(rows.select(F.col(key).cast("bigint").alias("key"), column).where(F.size(column) > 0).mapInArrow(_build(cosine), _LEAF), "leaves")
    for k in range(rounds):
        # the work of a task grows with the square of its leaves, so their number sets that of the tasks
        tasks = max(1, -(-leaves.count() // MERGED))
        merged = cut(leaves.withColumn("_key", _round_key(k)).repartition(tasks, "_key").drop("_key").mapInArrow(_reduce(cosine), _LEAF), "leaves")
        discard(leaves)
        leaves = merged
    # counts of a fixed number of cells, added up in two steps
    tasks = leaves.mapInArrow(_count_keys(cosine), "cells binary")
    counts = np.zeros(KEY_CELLS, np.int64)
    for (blob,) in tasks.repartition(8).mapInArrow(_add_counts, "cells binary").collect():
        counts += np.frombuffer(zlib.decompress(blob), np.int64)
    shared = leaves.sparkSession.sparkContext.broadcast(counts)
    met = leaves.mapInArrow(_pair_keys(cosine, shared, keyed), "key bigint, " + _LEAF)
    links = cut(met.repartition("key").sortWithinPartitions("key").mapInArrow(_links(cosine), "a bigint, b bigint").distinct(), "links")
    labels = components(links)
    labelled = leaves.join(labels, leaves.least == labels.leaf, "left")
    alone = labelled.where("label is null").select("n", "least", "topics", "vals")
    several = labelled.where("label is not null").select("label", "n", "least", "topics", "vals")
    merged = several.repartition("label").mapInArrow(_reduce(cosine), _LEAF)
    found = cut(alone.unionByName(merged), "centroids")
    for done in (leaves, links):
        discard(done)
    return found


def components(links: DataFrame) -> DataFrame:
    """(leaf, label): the smallest leaf of each connected component of links (a, b), for leaves that have any.

    Labels go along links and jump to the label of their label until none changes:
    two rounds where similarity is transitive, else about the logarithm of the longest chain.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b"), "both")
    held = cut(both.groupBy(F.col("a").alias("leaf")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        labels = held.select("leaf", "label")
        of = labels.select(F.col("leaf").alias("_leaf"), F.col("label").alias("_label"))
        near = both.join(of, F.col("b") == F.col("_leaf")).groupBy("a").agg(F.min("_label").alias("_near"))
        moved = labels.join(near, F.col("leaf") == F.col("a"), "left").select("leaf", F.least("label", F.coalesce("_near", "label")).alias("_new"), F.col("label").alias("_old"))
        jumped = moved.join(of, F.col("_new") == F.col("_leaf"), "left").select("leaf", F.least("_new", F.coalesce("_label", "_new")).alias("label"), "_old")
        after = cut(jumped, "labels")
        discard(held)
        held = after
        if after.where("label != _old").isEmpty():
            return after.select("leaf", "label")


def _assign(shared, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least, indptr, topics, values = shared.value
        means = Sparse(indptr, topics, values)
        index = Index(means)
        norms = np.sqrt(np.bincount(means.rows, weights=means.values**2, minlength=len(means)))
        for batch in batches:
            rows, vectors = unit_vectors(batch.column(1))
            if not len(rows):
                continue
            entry, dot = index.best(vectors, cosine)
            hit = np.flatnonzero(entry >= 0)
            e = entry[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[hit])), pa.array(least[e]), pa.array(n[e]), pa.array(dot[hit]), pa.array(np.minimum(dot[hit] / norms[e], 1.0)), batch.column(2).take(pa.array(rows[hit]))], names=["key", "cluster_id", "size", "similarity", "typicality", "_row"])

    return run


def assign(rows: DataFrame, found: DataFrame, least_size: int = 3, cosine: float = COSINE, key: str = "para_id", column: str = "topic_vec", block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(key, cluster_id, size, similarity, typicality) of the rows in clusters of at least least_size.

    One pass over the rows for each block of centroids; a block is held by every
    task and bounded in size, and of several blocks' centroids a row keeps the most
    similar one. similarity is the mean cosine with the members,
    typicality the cosine with the centroid.
    """
    spark = rows.sparkSession
    large = found.where(F.col("n") >= least_size)
    total = large.agg(F.coalesce(F.sum(F.size("topics")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_entries))
    kind = dict(rows.dtypes)[key]
    schema = f"key {kind}, cluster_id bigint, size bigint, similarity double, typicality double, _row bigint"
    out = None
    for k in range(blocks):
        mine = large if blocks == 1 else large.where(F.pmod(F.xxhash64("least"), F.lit(blocks)) == k)
        table = mine.toArrow()
        got = _read(table.to_batches()) if table.num_rows else Leaves(np.empty(0, np.int64), Sparse(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0)), np.empty(0, np.int64))
        means = got.means()
        shared = spark.sparkContext.broadcast((got.n, got.least, means.indptr, means.topics, means.values))
        part = rows.select(F.col(key).alias("key"), column, F.xxhash64(column).alias("_row")).where(F.size(column) > 0).mapInArrow(_assign(shared, cosine), schema)
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        # rows that repeat are equal in every block; they are counted, and put out as often again
        found_by = out.groupBy("key", "_row", "cluster_id", "size", "similarity", "typicality").agg(F.count(F.lit(1)).alias("_n"))
        best = F.max_by(F.struct("cluster_id", "size", "similarity", "typicality", "_n"), F.struct("similarity", -F.col("cluster_id")))
        out = found_by.groupBy("key", "_row").agg(best.alias("_b")).select("key", "_row", "_b.*").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).drop("_n")
    return out.drop("_row").withColumnRenamed("key", key)


def clustered(rows: DataFrame, cosine: float = COSINE, least_size: int = 3, key: str = "para_id", column: str = "topic_vec") -> DataFrame:
    """(key, cluster_id, size, similarity, typicality) of every row in a cluster of at least least_size.

    Rows are in one cluster when the cosine of their vectors is at least `cosine`;
    cluster_id is the smallest key of the cluster. Null and empty vectors, and such
    of zero length, take no part; a topic given twice counts with the sum of its
    values; null and infinite values count as zero. Rows that repeat count each.
    """
    return assign(rows, centroids(rows, cosine, key, column), least_size, cosine, key, column)


def typical_members(members: DataFrame, k: int = 3, key: str = "para_id") -> DataFrame:
    """The k members nearest to the centroid of each cluster: cluster_id, size, rank, key, typicality.

    Nine decimals of typicality count, so that sums in another order do not change the ranks; ties go by key.
    """
    order = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("typicality", 9)), key)
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("cluster_id", "size", "rank", key, "typicality")
