"""Texts packed into containers of fixed capacity.

Method: sum-of-squares online packing. A task keeps, for one capacity, the number of
open containers at each fill level. Each piece goes to the level (or a new
container) that makes the sum of the squared numbers least. What is still open at
the end of a shard is packed once more, whole containers as pieces.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.store import cut

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Texts that one task packs; far above the number of levels, so that what stays open is little.
SHARD = 50_000
_ENCODINGS: dict[str, object] = {}


def tokenizer_path(name: str = VOCABULARY, folder: str = "/opt/tokenizers") -> str:
    return os.path.join(folder, name)


def _encoding(path: str):
    import tiktoken

    if path not in _ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODINGS[path] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(texts: DataFrame, tokenizer: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_tokens) for each row with a text of at least one token, by a public byte-level tokenizer.

    tokenizer is the path of its ranks, to be found on every executor. Whole texts
    are counted, of any length; special tokens in a text are ordinary text.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "n_tokens"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, column).where(F.length(column) > 0).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


class Packer:
    """Sum-of-squares packing for one capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.used = 0
        # change of the sum of squares by taking one away from, or adding one to, each level
        self._less = np.full(capacity + 1, 1 << 40, np.int64)
        self._more = np.ones(capacity + 1, np.int64)
        self._more[capacity] = 0

    def _shift(self, level: int, by: int) -> None:
        if 0 < level < self.capacity:
            n = self.counts[level] = self.counts[level] + by
            self._less[level] = 1 - 2 * n if n else 1 << 40
            self._more[level] = 2 * n + 1

    def place(self, size: int) -> tuple[int, int]:
        """(container, fill before) for a piece of 1..capacity tokens."""
        rest = self.capacity - size
        level, change = 0, int(self._more[size])
        if rest:
            # the fullest of equally good levels
            deltas = (self._less[1 : rest + 1] + self._more[size + 1 : self.capacity + 1])[::-1]
            best = int(np.argmin(deltas))
            if deltas[best] <= change:
                level = rest - best
        if level:
            box = self.open[level].pop()
        else:
            box, self.used = self.used, self.used + 1
        self._shift(level, -1)
        self._shift(level + size, 1)
        if level + size < self.capacity:
            self.open.setdefault(level + size, []).append(box)
        return box, level


def pack_shard(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, tokens, container, fill before) of every piece; only sizes above the capacity are cut."""
    full, rest = np.divmod(sizes, capacity)
    pieces = full + (rest > 0)
    row = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    tokens = np.where(piece < full[row], capacity, rest[row])
    packer = Packer(capacity)
    placed = [packer.place(n) for n in tokens.tolist()]
    box = np.array([p[0] for p in placed], np.int64)
    fill = np.array([p[1] for p in placed], np.int64)
    # what stayed open, fullest first, as pieces of a second packing
    levels = sorted(((level, b) for level, boxes in packer.open.items() for b in boxes), reverse=True)
    if len(levels) > 1:
        again = Packer(capacity)
        moved, base = np.arange(packer.used), np.zeros(packer.used, np.int64)
        first: dict[int, int] = {}
        for level, b in levels:
            c, before = again.place(level)
            moved[b] = first.setdefault(c, b)
            base[b] = before
        box, fill = moved[box], fill + base[box]
    return row, piece, tokens, box, fill


def pack(texts: DataFrame, specs: DataFrame, tokenizer: str | None = None, shard: int = SHARD, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Pieces of texts in containers: spec_id, container_id, doc_id, piece, from_token, tokens, fill.

    For each row of specs (spec_id, capacity_tokens) every text stands in the result
    once: whole, or, if it has more tokens than the capacity, in full pieces and a
    rest. fill is what the container held before the piece. Null and empty texts
    have no tokens and take no part; rows that repeat are packed each for itself.
    Specs without a positive capacity are refused. An empty table gives no rows.

    Texts are spread at random over shards of about `shard` texts, packed each by
    one task; a shard leaves a handful of containers partly open.
    """
    capacities = [(r[0], r[1]) for r in specs.select("spec_id", "capacity_tokens").distinct().limit(1001).collect()]
    if len(capacities) > 1000 or any(c is None or c <= 0 for _, c in capacities):
        raise ValueError("specs: at most 1,000, each with a positive capacity")
    sizes = cut(token_counts(texts, tokenizer, key, column).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    shards = max(1, -(-sizes.count() // shard))
    by_spec = dict(capacities)
    if not by_spec:
        by_spec = {-1: 1}
        sizes = sizes.limit(0)
    kind = dict(texts.dtypes)[key]

    def run(keys, pdf):
        spec, number = int(keys[0]), int(keys[1])
        pdf = pdf.sort_values("_order", kind="stable")
        row, piece, tokens, box, fill = pack_shard(pdf["n_tokens"].to_numpy(), by_spec[spec])
        return pd.DataFrame(
            {"spec_id": spec, "container_id": (number << 32) + box, "key": pdf["key"].to_numpy()[row], "piece": piece, "from_token": piece * by_spec[spec], "tokens": tokens, "fill": fill}
        )

    spread = sizes.select(
        F.explode(F.array(*[F.lit(s) for s in by_spec])).alias("spec_id"), F.pmod(F.xxhash64("_row"), F.lit(shards)).alias("_shard"), F.xxhash64("_row", F.lit(1)).alias("_order"), F.col(key).alias("key"), "n_tokens"
    )
    out = spread.groupBy("spec_id", "_shard").applyInPandas(run, f"spec_id int, container_id bigint, key {kind}, piece int, from_token bigint, tokens bigint, fill bigint")
    return out.withColumnRenamed("key", key)


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """For each capacity: containers, texts, pieces, tokens and the part of the space that is used."""
    totals = packed.groupBy("spec_id").agg(F.countDistinct("container_id").alias("containers"), F.sum(F.when(F.col("piece") == 0, 1)).alias("texts"), F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    return totals.join(specs.select("spec_id", "capacity_tokens"), "spec_id").select("spec_id", "capacity_tokens", "containers", "texts", "pieces", "tokens", (F.col("tokens") / F.col("containers") / F.col("capacity_tokens")).alias("used"))
