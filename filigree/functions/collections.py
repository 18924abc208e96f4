"""Lists, maps, numbers and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat_lists(lists: Column) -> Column:
    return F.flatten(lists)


def merge_maps(*maps: Column) -> Column:
    """One map; the last value of a key wins, whatever the session's policy for repeated keys."""
    entries = F.flatten(F.array(*[F.map_entries(m) for m in maps]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, last)


def invert(m: Column) -> Column:
    return F.map_from_arrays(F.map_values(m), F.map_keys(m))


def chunks(items: Column, n: int) -> Column:
    """Consecutive pieces of n items; the last may be short."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(n)))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space; none if there are fewer."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def human_bytes(c: Column, base: int = 1024) -> Column:
    """A number of bytes in the largest fitting unit, rounded down; up to terabytes."""
    size = F.abs(c)
    power = F.greatest(F.lit(0), F.least(F.lit(4), F.when(size >= 1, F.floor(F.log(size) / F.log(F.lit(float(base))) + F.lit(1e-12))).otherwise(0)))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("b", "Kb", "Mb", "Gb", "Tb")]), (power + 1).cast("int"))
    return F.concat(F.round(c / F.pow(F.lit(float(base)), power), 0).cast("bigint").cast("string"), F.lit(" "), unit)


def day(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(c)


def quarter_bounds(year: Column, qtr: Column) -> tuple[Column, Column]:
    """Days that a filing of a quarter must lie between, both excluded."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(first, ((qtr - 1) * 87).cast("int")), F.date_add(first, F.floor(qtr * 91.5).cast("int"))


def positive_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums by key; what does not come out positive is dropped."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value)).where(F.col(value) > 0)


def common(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def either(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def zipped(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two aligned tables side by side: by the key that both carry, not by place, so partitions need not agree."""
    return a.join(b, key)


def sampled(df: DataFrame, part: float, seed: int = 0, most: int | None = None) -> DataFrame:
    """Each row with the chance `part`, up to `most` rows."""
    out = df.sample(part, seed=seed)
    return out if most is None else out.limit(most)


def taken(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first n rows in an order."""
    return df.orderBy(*order).limit(n)
