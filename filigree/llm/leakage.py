"""Evaluation texts that leaked into a corpus.

Method: every word becomes a template token - numbers, names and units become typed
placeholders, other words stand for themselves. Windows of template tokens of the
evaluation items and of all documents are joined by hash. For each hit the slots
are compared: all equal is a verbatim leak, a consistent renaming of slots is a
re-parameterised one.

What is a name or a unit follows from all items together. Neither items nor their
windows are held by a task: sets of hashes of a bounded size go to all tasks, and
the windows of documents that they let through meet those of the items in a join.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.bits import bits_for, gathered, opened, place
from filigree.llm.lookalike import LOOKS, Canon
from filigree.store import cut

WINDOW = 15
#: Words that a re-parameterised window must have outside its slots.
LITERAL = 9
#: Documents whose words are hashed at once.
CHUNK = 512
#: Part of an item's words inside sentences that are capitalised from which on capitals name nothing, as in German.
CAPITALS = 0.25
#: A unit follows a number at least so often, and in such a part of its places.
UNIT_PLACES, UNIT_PART = 2, 0.5
#: Bits of the sets sent to all tasks, at most: of words (three sets in one) and of windows.
WORD_BITS, WINDOW_BITS = 1 << 25, 1 << 27
NUM, NAME, UNIT = 1, 2, 3
_RUN = re.compile(r"\w+")

_FOLD = {ord(chr(cp).lower()): v.lower() for cp, v in LOOKS.items() if chr(cp).isupper()} | {cp: v for cp, v in LOOKS.items() if chr(cp).islower()}


@functools.lru_cache(1 << 18)
def fold(word: str) -> str:
    """A word without case; letters that look alike in either case are one letter."""
    low = word.lower()
    if low.isascii():
        return low
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", low).translate(_FOLD))


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits."""
    return _RUN.findall(text.replace("_", " ") if "_" in text else text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    n = len(tokens) - width + 1
    mixed = _mix(tokens.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + mixed[k : k + n]
    return out


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def facts(text: str) -> dict[str, tuple[int, int, int, int]]:
    """Folded word -> (places, those in lower case, those capitalised inside a sentence, those after a number) of an item in its one form."""
    places: dict[str, list[int]] = {}
    inside = capitals = 0
    for sentence in re.split(r"[.!?;:]\s|\n", text):
        before = ""
        for k, word in enumerate(words_of(sentence)):
            found = places.setdefault(fold(word), [0, 0, 0, 0])
            found[0] += 1
            found[1] += word[0].islower()
            if k and word[0].isalpha():
                inside += 1
                capitals += word[0].isupper()
                found[2] += word[0].isupper()
            found[3] += before.isdigit()
            before = word
    named = capitals <= CAPITALS * inside
    return {w: (n, low, capital if named else 0, after) for w, (n, low, capital, after) in places.items()}


def _facts(canon: Canon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, *f) for text in batch.column(0).to_pylist() for w, f in facts(canon.text(text)).items()]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["word", "n", "low", "capital", "after"])

    return run


def _kind_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of (kind, word): every word is known, some are names or units by what was counted of them."""
    for batch in batches:
        out = []
        for word, n, low, capital, after in zip(*(c.to_pylist() for c in batch.columns)):
            out.append(_keyed(0, word_hash(word)))
            if any(c.isdigit() for c in word):
                continue
            if after >= UNIT_PLACES and after >= UNIT_PART * n:
                out.append(_keyed(UNIT, word_hash(word)))
            elif capital and not low:
                out.append(_keyed(NAME, word_hash(word)))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64))], names=["hash"])


def _keyed(kind: int, hashed: int) -> int:
    return (hashed * 4 + kind) & 0xFFFFFFFFFFFFFFFF


class Words(dict):
    """Word as it stands -> template token; filled as words come.

    The sets may take a word for a name or a unit that is none; as they do so in
    items and documents alike, no window is lost by it.
    """

    def __init__(self, packed: bytes) -> None:
        super().__init__()
        self.bits = opened(packed)

    def holds(self, kind: int, hashed: int) -> bool:
        return bool(self.bits[place(np.array([_keyed(kind, hashed)], np.uint64), len(self.bits))[0]])

    def kind(self, folded: str, hashed: int, capital: bool) -> int:
        """Placeholder of a word, or 0 where it stands for itself. A capitalised word that no item has may be another name."""
        if any(c.isdigit() for c in folded):
            return NUM
        if self.holds(UNIT, hashed):
            return UNIT
        if self.holds(NAME, hashed) or capital and not self.holds(0, hashed):
            return NAME
        return 0

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 19:
            self.clear()
        folded = fold(word)
        hashed = word_hash(folded)
        self[word] = found = self.kind(folded, hashed, word[0].isupper()) or max(hashed, 16)
        return found


def _kinds(tokens: np.ndarray) -> str:
    return "".join(str(min(t, 4)) for t in tokens.tolist())


def _item_windows(shared, width: int, canon: Canon):
    """(hash, item, words, kinds, place) of the template windows of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(shared.value)
        for batch in batches:
            rows, hashes, windows, kinds, places = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(canon.text(text))
                if len(words) < width:
                    continue
                tokens = np.array([known[w] for w in words], np.uint64)
                folded = [fold(w) for w in words]
                hashed = _window_hashes(tokens, width)
                for k in range(len(hashed)):
                    rows.append(row)
                    windows.append(" ".join(folded[k : k + width]))
                    kinds.append(_kinds(tokens[k : k + width]))
                    places.append(k)
                hashes.append(hashed)
            column = pa.array((np.concatenate(hashes) if hashes else np.empty(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([column, batch.column(0).take(pa.array(rows, pa.int64())), pa.array(windows, pa.string()), pa.array(kinds, pa.string()), pa.array(places, pa.int64())], names=["hash", "item", "words", "kinds", "place"])

    return run


def _document_windows(sets, width: int, canon: Canon):
    """(hash, doc, found, place) of the template windows of documents that the set of those of the items lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, windows = sets.value
        known, wanted = Words(kinds), opened(windows)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                words: list[str] = []
                ends = []
                for text in batch.column(1).slice(start, CHUNK).to_pylist():
                    words += words_of(canon.text(text))
                    ends.append(len(words))
                if len(words) < width:
                    continue
                hashes = _window_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), width)
                hits = np.flatnonzero(wanted[place(hashes, len(wanted))])
                ends_at = np.array(ends)
                rows = np.searchsorted(ends_at, hits, side="right")
                inside = hits + width <= ends_at[rows]
                hits, rows = hits[inside], rows[inside]
                found = [" ".join(fold(w) for w in words[k : k + width]) for k in hits.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[hits].view(np.int64)), batch.column(0).take(pa.array(start + rows)), pa.array(found, pa.string()), pa.array(hits)], names=["hash", "doc", "found", "place"])

    return run


def consistent(words: str, found: str, kinds: str) -> bool:
    """Whether equal slots of the item stand for equal slots of the document, and the other way round; words outside slots are equal."""
    there: dict[tuple[str, str], str] = {}
    back: dict[tuple[str, str], str] = {}
    for w, x, t in zip(words.split(" "), found.split(" "), kinds):
        if t != "4":
            if there.setdefault((t, w), x) != x or back.setdefault((t, x), w) != w:
                return False
        elif w != x:
            return False
    return True


def _renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [consistent(*x) for x in zip(*(batch[k].to_pylist() for k in ("words", "found", "kinds")))]
        yield batch.select(["doc", "item", "place"]).filter(pa.array(keep, pa.bool_()))


def leaks(documents: DataFrame, items: DataFrame, width: int = WINDOW, reparametrised: bool = False, literal: int = LITERAL, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(doc_id, item_id, verbatim, windows): documents that hold `width` consecutive words of an item.

    Words are runs of letters and digits in the one form of a text, without case.
    verbatim rows have the item's own words; with reparametrised=True there are
    also rows for windows that agree but for a consistent exchange of numbers,
    names and units and have at least `literal` words outside such slots. windows
    counts the document's windows. A document and an item give at most one row of
    either kind. Null and empty texts, and items of fewer words, give none. Whole
    texts are searched, in one pass however many items there are. Rows of one key
    count as one. Other columns are ignored.
    """
    canon = Canon()
    spark = documents.sparkSession
    kinds = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    held = items.where(F.length("text") > 0).select(F.col(item_key).alias("item"), "text")
    counted = held.select("text").mapInArrow(_facts(canon), "word string, n bigint, low bigint, capital bigint, after bigint")
    counted = cut(counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "low", "capital", "after")]), "words")
    word_set = gathered(counted.mapInArrow(_kind_hashes, "hash bigint"), bits_for(counted.count(), 64, WORD_BITS))
    windows = cut(held.mapInArrow(_item_windows(spark.sparkContext.broadcast(word_set), width, canon), f"hash bigint, item {kinds[1]}, words string, kinds string, place bigint"), "windows")
    window_set = gathered(windows.select("hash"), bits_for(windows.count(), 256, WINDOW_BITS))
    sets = spark.sparkContext.broadcast((word_set, window_set))
    texts = documents.where(F.length("text") > 0).select(F.col(key).alias("doc"), "text")
    seen = texts.mapInArrow(_document_windows(sets, width, canon), f"hash bigint, doc {kinds[0]}, found string, place bigint")
    met = seen.join(windows.select("hash", "item", "words", "kinds").distinct(), "hash")
    same = met.where("words = found").select("doc", "item", "place", F.lit(True).alias("verbatim"))
    if reparametrised:
        # both kinds come from one pass over the documents
        met = cut(met, "met")
        same = met.where("words = found").select("doc", "item", "place", F.lit(True).alias("verbatim"))
        other = met.where((F.col("words") != F.col("found")) & (F.length(F.regexp_replace("kinds", "[^4]", "")) >= literal))
        other = other.select("doc", "item", "place", "words", "found", "kinds").mapInArrow(_renamed, f"doc {kinds[0]}, item {kinds[1]}, place bigint")
        same = same.unionByName(other.withColumn("verbatim", F.lit(False)))
    out = same.groupBy("doc", "item", "verbatim").agg(F.count_distinct("place").alias("windows"))
    return out.select(F.col("doc").alias(key), F.col("item").alias(item_key), "verbatim", "windows")
