"""How often every distinct term occurs, and in how many records.

Method: recursive radix partitioning. Tasks add up the terms of their own rows with
DuckDB before anything moves; the sums are partitioned by the upper bits of the
terms' hashes. A task that gets more than it may hold writes its part to disk by
the next bits, again and again for parts that are still too large, and adds up each
part out of core with DuckDB.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.session import shared_dir
from filigree.store import cut

#: Entries that are added up at once on the way in.
CHUNK = 600_000
#: Rows of one part that a task adds up without splitting further.
PART_ROWS = 2_000_000
FAN = 16
MEMORY = "256MB"
RARE, COMMON = 2, 0.2
_PARTS = pa.schema([("field", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("records", pa.int64())])


def scratch_root(spark: SparkSession) -> str:
    """Where tasks may write parts: the shared folder if it is mounted, else the folders where Spark itself spills."""
    shared = shared_dir(spark)
    return shared.removeprefix("file://") if shared.startswith(("file:", "/")) else ""


def _scratch(root: str) -> str:
    base = root or os.environ.get("SPARK_LOCAL_DIRS", os.environ.get("LOCAL_DIRS", "")).split(",")[0]
    if not base:
        raise ValueError("no folder for parts: the shared one is not mounted, and Spark names none for spilling")
    path = os.path.join(base, f"radix-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _connect(folder: str):
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})


def _entries(column: pa.Array, nested: bool) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(row, term, count) of a map column; nested: the terms are the keys of the inner maps."""

    def flat(maps: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        lengths = pc.fill_null(pc.list_value_length(maps.cast(pa.list_(pa.struct([("key", maps.type.key_type), ("value", maps.type.item_type)])))), 0)
        rows = np.repeat(np.arange(len(maps)), lengths.to_numpy(zero_copy_only=False))
        inner = pc.list_flatten(maps.cast(pa.list_(pa.struct([("key", maps.type.key_type), ("value", maps.type.item_type)]))))
        return rows, pc.struct_field(inner, 0), pc.struct_field(inner, 1)

    rows, terms, counts = flat(column)
    if nested:
        inner, terms, counts = flat(counts)
        rows = rows[inner]
    return rows, terms, counts


def _add_up(fields: tuple[str, ...], scratch: str):
    """Terms of a task's own rows; the rows with a non-null field are counted under the null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _scratch(scratch)
        db = _connect(folder)
        held: dict[str, list[pa.Table]] = {f: [] for f in fields}
        rows = {f: 0 for f in fields}
        seen = dict.fromkeys(fields, 0)

        def flush(field: str) -> Iterator[pa.RecordBatch]:
            entries = pa.concat_tables(held[field])  # noqa: F841 - DuckDB reads it by name
            held[field], rows[field] = [], 0
            repeated = "select row, term, sum(n) n from entries group by all" if nested[field] else "entries"
            out = db.sql(f"select '{field}' field, term, sum(coalesce(n, 0))::bigint total, count(*)::bigint records from ({repeated}) group by term").to_arrow_table()
            yield from out.cast(_PARTS).combine_chunks().to_batches(max_chunksize=100_000)

        nested: dict[str, bool] = {}
        at = 0
        try:
            for batch in batches:
                for k, field in enumerate(fields):
                    column = batch.column(k)
                    nested[field] = pa.types.is_map(column.type.item_type)
                    seen[field] += len(column) - column.null_count
                    row, terms, counts = _entries(column, nested[field])
                    held[field].append(pa.table({"row": row + at, "term": terms, "n": counts.cast(pa.int64())}))
                    rows[field] += len(row)
                    if rows[field] >= CHUNK:
                        yield from flush(field)
                at += batch.num_rows
            for field in fields:
                if rows[field]:
                    yield from flush(field)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.nulls(len(seen), pa.string()), pa.array([0] * len(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], schema=_PARTS)
        finally:
            db.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


class _Radix:
    """Parts of one task's rows on disk, by a few bits of their hashes."""

    def __init__(self, folder: str, depth: int) -> None:
        self.folder, self.depth = folder, depth
        self.writers: dict[int, pa.ipc.RecordBatchFileWriter] = {}
        self.rows = dict.fromkeys(range(FAN), 0)

    def path(self, part: int) -> str:
        return os.path.join(self.folder, f"{self.depth}-{part}.arrow")

    def write(self, batch: pa.RecordBatch) -> None:
        parts = (batch["hash"].to_numpy() >> (4 * self.depth)) & (FAN - 1)
        for part in np.unique(parts).tolist():
            mine = batch.filter(pa.array(parts == part))
            if part not in self.writers:
                self.writers[part] = pa.ipc.new_file(self.path(part), batch.schema)
            self.writers[part].write_batch(mine)
            self.rows[part] += mine.num_rows

    def close(self) -> list[tuple[str, int]]:
        for writer in self.writers.values():
            writer.close()
        return [(self.path(p), n) for p, n in self.rows.items() if n]


def _finish(part_rows: int, scratch: str):
    """Final sums of one partition: in memory if it is small, else part by part from disk."""

    def total(db, found: pa.Table) -> Iterator[pa.RecordBatch]:
        out = db.sql("select field, term, sum(total)::bigint total, sum(records)::bigint records from found group by all").to_arrow_table()
        yield from out.cast(_PARTS).combine_chunks().to_batches(max_chunksize=100_000)

    def spread(stream: Iterator[pa.RecordBatch], folder: str, depth: int, db) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, radix = 0, None
        for batch in stream:
            if radix is None:
                held.append(batch)
                rows += batch.num_rows
                if rows > part_rows and depth < 12:
                    os.makedirs(folder, exist_ok=True)
                    radix = _Radix(folder, depth)
                    for b in held:
                        radix.write(b)
                    held = []
            else:
                radix.write(batch)
        if radix is None:
            if held:
                yield from total(db, pa.Table.from_batches(held))
            return
        for k, (path, _) in enumerate(radix.close()):
            with pa.OSFile(path) as file:
                reader = pa.ipc.open_file(file)
                yield from spread((reader.get_batch(i) for i in range(reader.num_record_batches)), os.path.join(folder, str(k)), depth + 1, db)
            os.remove(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _scratch(scratch)
        db = _connect(folder)
        try:
            yield from spread(batches, os.path.join(folder, "p"), 0, db)
        finally:
            db.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def term_counts(rows: DataFrame, fields: tuple[str, ...] = ("counter", "unstem_map"), part_rows: int = PART_ROWS) -> DataFrame:
    """(field, term, total, records) of every distinct term, and a row with a null term for each field.

    fields name map columns: term to count, or a map of such maps, whose inner keys
    are then the terms, whatever the outer key. total adds the counts (a null count
    adds nothing), records counts the rows that hold the term, each once. The row
    with the null term has in records the number of rows with a non-null field.
    Every row counts, repeated ones too; terms are compared exactly. An empty table
    gives only rows with null terms, or none.
    """
    spark = rows.sparkSession
    scratch = scratch_root(spark)
    schema = "field string, term string, total bigint, records bigint"
    own = rows.select(*fields).mapInArrow(_add_up(fields, scratch), schema)
    hashed = own.withColumn("hash", F.xxhash64("field", "term"))
    parted = hashed.repartition(F.shiftrightunsigned("hash", 48))
    return parted.mapInArrow(_finish(part_rows, scratch), schema)


def marked_terms(rows: DataFrame, fields: tuple[str, ...] = ("counter", "unstem_map"), rare: int = RARE, common: float = COMMON, part_rows: int = PART_ROWS) -> DataFrame:
    """(field, term, total, records, mark): mark is `rare` for terms in at most `rare` rows,
    `common` for those in more than the part `common` of the rows with a non-null field, else null.

    A term that is both, as in tiny tables, is `rare`.
    """
    counts = cut(term_counts(rows, fields, part_rows), "terms")
    held = {r.field: r.records for r in counts.where("term is null").groupBy("field").agg(F.sum("records").alias("records")).collect()}
    most = F.lit(None).cast("double")
    for field, n in held.items():
        most = F.when(F.col("field") == field, F.lit(float(common * n))).otherwise(most)
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > most, "common")
    return counts.where("term is not null").withColumn("mark", mark)
