"""Written tables: cut lineage, and the memo of expensive results."""

from __future__ import annotations

import functools
import hashlib
import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.session import shared_dir


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors: the files lie in the
    folder of ``spark.checkpoint.dir`` and go when the driver's JVM ends, by
    discard() once nothing reads them any more, or by free().
    """
    spark = df.sparkSession
    uri = f"{shared_dir(spark)}/filigree/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(uri)
    fs, path = _path(spark, uri)
    fs.deleteOnExit(path)
    found = spark.read.schema(df.schema).parquet(uri)
    _CUT.setdefault(spark.sparkContext.applicationId, {})[uri] = uri
    found._cut_at = uri
    return found


#: Written tables by application.
_CUT: dict[str, dict[str, str]] = {}


def discard(df: DataFrame) -> None:
    """Deletes a table that cut() returned; nothing built on it may be computed after that."""
    uri = getattr(df, "_cut_at", None)
    if uri:
        fs, path = _path(df.sparkSession, uri)
        fs.delete(path, True)
        _CUT.get(df.sparkSession.sparkContext.applicationId, {}).pop(uri, None)


def free(spark: SparkSession) -> int:
    """Deletes all tables that cut() wrote in this application, for long sessions; results must have been written by then."""
    found = _CUT.pop(spark.sparkContext.applicationId, {})
    for uri in found.values():
        fs, path = _path(spark, uri)
        fs.delete(path, True)
    return len(found)


def canonical(obj) -> str:
    """One text for equal arguments: dict order is ignored, floats count to three decimals."""

    def plain(x):
        if x is None or isinstance(x, (bool, int, str)):
            return x
        if isinstance(x, float):
            return f"{x:.3f}"
        if isinstance(x, (list, tuple)):
            return [plain(y) for y in x]
        if isinstance(x, (set, frozenset)):
            return {"set": sorted(json.dumps(plain(y)) for y in x)}
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        raise TypeError(f"not usable as a key: {type(x).__name__}")

    return json.dumps(plain(obj), sort_keys=True, separators=(",", ":"))


class Memo:
    """Results of functions that return a DataFrame, written once per function and arguments.

    A result counts as complete when its ``_SUCCESS`` file is there; a partial one
    is written again. ``enabled=False`` computes without storing.
    """

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True) -> None:
        self.spark, self.root, self.enabled = spark, root.rstrip("/"), enabled
        self.hits, self.misses = 0, 0
        self._locks: dict[str, threading.RLock] = {}
        self._lock = threading.Lock()

    def _held(self, name: str) -> threading.RLock:
        """One lock a function: two threads do not compute the same result, and a function may call itself."""
        with self._lock:
            return self._locks.setdefault(name, threading.RLock())

    def decor(self, name: str, version: str = "") -> Callable:
        """A decorator; the function is then called with keywords only."""

        def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            return functools.wraps(fn)(lambda **args: self(name, fn, version, **args))

        return wrap

    def location(self, name: str, args: dict, version: str = "") -> str:
        key = hashlib.sha256(canonical(args).encode()).hexdigest()[:32]
        return f"{self.root}/{name}{'-' + version if version else ''}/{key}"

    def __call__(self, name: str, fn: Callable[..., DataFrame], version: str = "", **args) -> DataFrame:
        if not self.enabled:
            return fn(**args)
        with self._held(name):
            found = self._load(name, args, version)
            if found is None:
                self.misses += 1
                return self._store(name, args, version, fn(**args))
            self.hits += 1
            return found

    def _load(self, name: str, args: dict, version: str) -> DataFrame | None:
        uri = self.location(name, args, version)
        fs, done = _path(self.spark, f"{uri}/_SUCCESS")
        return self.spark.read.parquet(uri) if fs.exists(done) else None

    def _store(self, name: str, args: dict, version: str, result: DataFrame) -> DataFrame:
        uri = self.location(name, args, version)
        result.write.mode("overwrite").parquet(uri)
        return self.spark.read.parquet(uri)

    def clear(self, name: str) -> None:
        fs, root = _path(self.spark, self.root)
        if not fs.exists(root):
            return
        for status in fs.listStatus(root):
            found = status.getPath().getName()
            if found == name or found.startswith(name + "-"):
                fs.delete(status.getPath(), True)


class MemoryMemo(Memo):
    """A memo for one session: results are persisted by the executors, spilling to disk, and computed again if one is lost."""

    def __init__(self, spark: SparkSession, enabled: bool = True) -> None:
        super().__init__(spark, "memory:", enabled)
        self.results: dict[str, DataFrame] = {}

    def _load(self, name: str, args: dict, version: str) -> DataFrame | None:
        return self.results.get(self.location(name, args, version))

    def _store(self, name: str, args: dict, version: str, result: DataFrame) -> DataFrame:
        found = self.results[self.location(name, args, version)] = result.persist()
        return found

    def clear(self, name: str) -> None:
        for where in [w for w in self.results if w.split("/")[1] == name or w.split("/")[1].startswith(name + "-")]:
            self.results.pop(where).unpersist()


class TableMemo(Memo):
    """A memo with one table a function, `<name>_cache`, in which each result is a partition by its key.

    For many small results. Adding one does not write the others again; an empty
    result leaves no partition and is computed each time.
    """

    def _table(self, name: str, args: dict, version: str) -> tuple[str, str]:
        where, key = self.location(name, args, version).rsplit("/", 1)
        return f"{where}_cache", key

    def _load(self, name: str, args: dict, version: str) -> DataFrame | None:
        where, key = self._table(name, args, version)
        fs, part = _path(self.spark, f"{where}/_key={key}")
        return self.spark.read.parquet(str(part.toString())) if fs.exists(part) else None

    def _store(self, name: str, args: dict, version: str, result: DataFrame) -> DataFrame:
        where, key = self._table(name, args, version)
        result.withColumn("_key", F.lit(key)).write.mode("append").partitionBy("_key").parquet(where)
        found = self._load(name, args, version)
        return result if found is None else found

    def clear(self, name: str) -> None:
        fs, root = _path(self.spark, self.root)
        for status in fs.listStatus(root) if fs.exists(root) else ():
            found = status.getPath().getName()
            if found.endswith("_cache") and (found == f"{name}_cache" or found.startswith(name + "-")):
                fs.delete(status.getPath(), True)
