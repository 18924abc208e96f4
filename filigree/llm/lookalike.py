"""Texts that look the same brought to one form.

Method: words are looked up in a trie of the corpus's vocabulary by an edit
automaton with weights. Exchanging look-alike letters, full-width and other
compatibility forms, composed and combining accents, and dropping what is
invisible cost nothing; another accent or case, and other letters, cost more than
the budget, which is zero where texts are to keep what can be seen. The node reached
names the canonical spelling: the most frequent one of a look, so a word of letters
that two scripts share is spelt in the script in which the corpus writes it. Words
that the vocabulary does not hold, and all other characters, go by table. A look has
one spelling, by whichever way, so texts look the same exactly when their forms are
equal.

A vocabulary can be stored with its version. Forms of one version are comparable
and do not change as a corpus grows.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.store import cut

# Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜӀаеѕіјорсухԁԛԝһӏ", "ABESIJKMHOPCTYXYQWIaesijopcyxdqwhl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"))
ARMENIAN = dict(zip("ՍՕօ", "UOo"))
# Other characters of equal look.
OTHER = {0x02BC: "’", 0x00B5: "μ", 0x2010: "-", 0x2011: "-", 0x2028: "\n", 0x2029: "\n"}
# Compatibility kinds whose characters look like what they stand for.
KINDS = ("<wide>", "<narrow>", "<noBreak>")
# Ligatures and joined letters, first and last of each range.
JOINED = ((0x0132, 0x0133), (0x01C7, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
# Invisible characters besides those of the category Cf.
UNSEEN = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))

LOOKS = {ord(k): v for k, v in (CYRILLIC | GREEK | ARMENIAN).items()}
RESTORE = dict(zip("ABESIJKMHOPCTYXaesijopcyx", "АВЕЅІЈКМНОРСТУХаеѕіјорсух"))
#: A word in raw text: letters, marks, letter numbers, and what is invisible.
WORD = regex.compile(r"[\p{L}\p{M}\p{Nl}\p{Cf}\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f--ʼ]+", regex.V1)
PLAIN_WORD = re.compile(r"[^\W\d_]+")
MIN_COUNT = 3
#: Spellings that the table would give as well, held at most; those that it would not give are held all.
MAX_VOCABULARY = 200_000
#: Letters that a word must have to be spelt in another script than Latin where all its letters look Latin.
FOREIGN = 3
#: What the automaton pays for a change that can be seen.
WEIGHTS = {"accent": 1.0, "case": 1.0, "letter": 2.0}
HELD = 200_000


def _within(cp: int, ranges) -> bool:
    return any(a <= cp <= b for a, b in ranges)


@functools.cache
def table() -> dict[int, str]:
    """What single characters become: nothing, a space, a line break or the ordinary form."""
    found: dict[int, str] = {}
    for cp in itertools.chain(range(0x20), range(0x7F, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x10000), range(0xE0000, 0xE01F0)):
        char, kind = chr(cp), unicodedata.category(chr(cp))
        if cp in OTHER:
            found[cp] = OTHER[cp]
        elif kind == "Cc" and char not in "\t\n\r\x0b\x0c\x85" or _within(cp, UNSEEN):
            found[cp] = ""
        elif kind == "Cf" and not unicodedata.name(char, "").startswith(("ARABIC", "SYRIAC", "KAITHI")):
            found[cp] = ""
        elif kind == "Zs" and cp not in (0x20, 0x1680):
            found[cp] = " "
        elif _within(cp, JOINED) or unicodedata.decomposition(char).startswith(KINDS):
            found[cp] = unicodedata.normalize("NFKC", char)
    return found


@functools.cache
def odd() -> frozenset[str]:
    """Characters by which a text may differ from its form, and letters of scripts with look-alikes."""
    points = set(table()) | set(LOOKS) | set(range(0x370, 0x590))
    for cp in itertools.chain(range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x10000), range(0x1D100, 0x1D250), range(0x2F800, 0x2FA20)):
        char = chr(cp)
        if unicodedata.category(char)[0] == "M" or unicodedata.normalize("NFC", char) != char:
            points.add(cp)
    return frozenset(map(chr, points))


@functools.cache
def _given() -> re.Pattern:
    """Finds what the table changes."""
    return re.compile("[" + "".join(f"\\U{cp:08x}" for cp in table()) + "]")


def _looks(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(LOOKS))


@functools.lru_cache(1 << 16)
def skeleton(word: str) -> str:
    """What all spellings of one look share: no invisible characters, Latin letters wherever one looks alike."""
    return _looks(word.translate(table()))


@functools.lru_cache(1 << 16)
def by_table(look: str) -> str:
    """Spelling of a skeleton: Cyrillic where it has letters of only that script and none of only another, else as it is."""
    if look.isascii():
        return look
    whole = unicodedata.normalize("NFD", look)
    letters = [c for c in whole if c.isalpha()]
    own = ["Ѐ" <= c <= "ԯ" for c in letters]
    if not any(own) or not all(mine or c in RESTORE for c, mine in zip(letters, own)):
        return look
    return unicodedata.normalize("NFC", "".join(RESTORE.get(c, c) for c in whole))


def is_plain(look: str) -> bool:
    return odd().isdisjoint(look)


@functools.cache
def _peers() -> dict[str, tuple[str, ...]]:
    """Letters of equal look, by the Latin one."""
    found: dict[str, list[str]] = {}
    for cp, latin in LOOKS.items():
        found.setdefault(latin, [latin]).append(chr(cp))
    return {k: tuple(v) for k, v in found.items()}


def _change(edge: str, look: str) -> float:
    """Weight of reading a letter of the trie as another look."""
    a, b = (unicodedata.normalize("NFD", _looks(x)) for x in (edge, look))
    if a == b:
        return 0.0
    if a[:1] == b[:1]:
        return WEIGHTS["accent"]
    return WEIGHTS["case"] if a.lower() == b.lower() else WEIGHTS["letter"]


class Trie:
    """Canonical spellings, by their characters."""

    def __init__(self, spellings) -> None:
        self.root: dict = {}
        for spelling in spellings:
            node = self.root
            for char in spelling:
                node = node.setdefault(char, {})
            node[""] = spelling

    def walk(self, word: str, budget: float = 0.0) -> tuple[float, str] | None:
        """(cost, spelling) of the cheapest canonical spelling within the budget, ties by spelling, or None.

        States are nodes with the least cost at which they are reached. A cluster
        of a letter and its marks moves along edges by weight; an invisible
        character leaves the states as they are; a ligature moves along several
        edges. Letters left out or put in weigh as much as other letters.
        """
        if not budget:
            return self._alike(word)
        states: dict[int, tuple[float, dict]] = {id(self.root): (0.0, self.root)}
        for look in self._clusters(word):
            states = self._step(self._spread(states, budget), look, budget)
            if not states:
                return None
        ends = [(cost, node[""]) for cost, node in self._spread(states, budget).values() if "" in node]
        return min(ends, default=None)

    def _alike(self, word: str) -> tuple[float, str] | None:
        """walk() where nothing that can be seen may change: states need no costs."""
        nodes = [self.root]
        for look in self._clusters(word):
            nodes = [n[e] for n in nodes for e in self._edges(look) if e in n]
            if not nodes:
                return None
        return min(((0.0, n[""]) for n in nodes if "" in n), default=None)

    @staticmethod
    def _clusters(word: str) -> Iterator[str]:
        """Looks of the letters of a word with their marks, without what is invisible."""
        given, cluster = table(), ""
        for char in [*word, ""]:
            for part in given.get(ord(char), char) if char else [""]:
                if part and cluster and unicodedata.combining(part):
                    cluster += part
                    continue
                yield from _looks(cluster)
                cluster = part

    def _step(self, states: dict, look: str, budget: float) -> dict:
        found: dict[int, tuple[float, dict]] = {}

        def reach(cost: float, node: dict) -> None:
            if cost <= budget and cost < found.get(id(node), (budget + 1,))[0]:
                found[id(node)] = cost, node

        for cost, node in states.values():
            for edge in self._edges(look):
                if edge in node:
                    reach(cost, node[edge])
            if budget > cost:
                for edge, child in node.items():
                    if edge:
                        reach(cost + _change(edge, look), child)
                reach(cost + WEIGHTS["letter"], node)
        return found

    def _spread(self, states: dict, budget: float) -> dict:
        """States with those reached by leaving out letters of the trie."""
        todo = list(states.values())
        found = dict(states)
        while todo:
            cost, node = todo.pop()
            more = cost + WEIGHTS["letter"]
            if more <= budget:
                for edge, child in node.items():
                    if edge and more < found.get(id(child), (budget + 1,))[0]:
                        found[id(child)] = more, child
                        todo.append((more, child))
        return found

    @staticmethod
    @functools.lru_cache(1 << 14)
    def _edges(look: str) -> tuple[str, ...]:
        whole = unicodedata.normalize("NFD", look)
        return tuple(dict.fromkeys(unicodedata.normalize("NFC", base + whole[1:]) for base in _peers().get(whole[0], (whole[0],))))


class _Words(dict):
    """Word as it stands -> its form; filled as words come."""

    def __init__(self, canon: Canon) -> None:
        super().__init__()
        self.canon = canon

    def __missing__(self, word: str) -> str:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = found = self.canon.word(word)
        return found


class Canon:
    """The one form of texts, given canonical spellings (one for each skeleton)."""

    def __init__(self, spellings: tuple[str, ...] = ()) -> None:
        self.spellings = tuple(spellings)
        #: Words of plain Latin letters that are spelt in another script.
        self.foreign = {look: s for s in self.spellings if not is_plain(s) and is_plain(look := skeleton(s))}
        self._trie: Trie | None = None
        self._words = _Words(self)

    def __getstate__(self):
        return self.spellings

    def __setstate__(self, spellings) -> None:
        self.__init__(spellings)

    @property
    def version(self) -> str:
        """Names the spellings and the rules; forms of one version are comparable."""
        return xxhash.xxh3_128_hexdigest("\n".join(["1", *sorted(self.spellings)]).encode())

    def word(self, word: str) -> str:
        if is_plain(word) and word not in self.foreign:
            return word
        self._trie = self._trie or Trie(self.spellings)
        found = self._trie.walk(word)
        return by_table(skeleton(word)) if found is None else found[1]

    def text(self, text: str) -> str:
        if "\r\n" in text:
            text = text.replace("\r\n", "\n")
        if odd().isdisjoint(set(text)) and self.foreign.keys().isdisjoint(PLAIN_WORD.findall(text) if self.foreign else ()):
            return text
        words = WORD.sub(lambda m: self._words[m[0]], text)
        given = table()
        return _given().sub(lambda m: given[ord(m[0])], words)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rare, counts = odd(), Counter()

    def flush():
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                if not rare.isdisjoint(set(text)):
                    counts.update(w for w in WORD.findall(text) if is_clean(w))
                else:
                    counts.update(PLAIN_WORD.findall(text))
            if len(counts) >= HELD:
                yield from flush()
    if counts:
        yield from flush()


@functools.lru_cache(1 << 16)
def is_clean(word: str) -> bool:
    """A spelling fit to be canonical: composed, nothing invisible, no look-alikes of another script mixed in."""
    return bool(word) and word == by_table(skeleton(word)) or word.isalpha() and word == unicodedata.normalize("NFKC", word) and all("Ѐ" <= c <= "ԯ" for c in word)


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(look, word, n, by_table) of words that may be the canonical spelling of their look."""
    for batch in batches:
        rows = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            look = skeleton(word)
            if not is_plain(look) or word == look or len(word) >= FOREIGN:
                rows.append((look, word, n, word == by_table(look)))
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.bool_())], names=["look", "word", "n", "by_table"])


def vocabulary(texts: DataFrame, column: str = "text", min_count: int = MIN_COUNT, most: int = MAX_VOCABULARY) -> Canon:
    """The canonical spellings of a corpus: for each look the most frequent clean spelling.

    Counts every word of every text; spellings seen at least min_count times stand
    for their look, ties going to the smaller string. A look of Latin letters is
    spelt in another script only by words of three letters or more. Spellings that
    the table would not give are held all: their number is that of words which two
    scripts can write alike. Of the others, `most` are held; the rest goes by table
    and comes out the same.
    """
    counted = texts.select(column).where(F.col(column).isNotNull()).mapInArrow(_count_words, "word string, n bigint")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    spelt = counted.mapInArrow(_spelt, "look string, word string, n bigint, by_table boolean")
    best = cut(spelt.groupBy("look").agg(F.min(F.struct((-F.col("n")).alias("n"), "word", "by_table")).alias("s")).select("s.*"), "spellings")
    held = best.where("not by_table").collect() + best.where("by_table").orderBy("n", "word").limit(most).collect()
    return Canon(tuple(sorted(r.word for r in held)))


def store_vocabulary(spark: SparkSession, canon: Canon, path: str) -> str:
    """Writes the spellings under their version, which is returned; the same version is not written again."""
    where = f"{path.rstrip('/')}/{canon.version}"
    spark.createDataFrame([(s,) for s in canon.spellings], "spelling string").write.mode("ignore").parquet(where)
    return canon.version


def stored_vocabulary(spark: SparkSession, path: str, version: str) -> Canon:
    canon = Canon(tuple(sorted(r.spelling for r in spark.read.parquet(f"{path.rstrip('/')}/{version}").collect())))
    if canon.version != version:
        raise ValueError(f"the vocabulary under {path} is not of version {version}")
    return canon


def canonical_texts(texts: DataFrame, key: str = "doc_id", column: str = "text", canon: Canon | None = None) -> DataFrame:
    """One row (key, form) for each row: the text in its one form.

    A null text stays null, an empty one empty; texts of any length are taken
    whole. Other columns are dropped, whatever their names.
    """
    canon = canon or vocabulary(texts, column)

    def run(batches):
        for batch in batches:
            forms = [None if t is None else canon.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=["key", "form"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, column).mapInArrow(run, f"key {kind}, form string").withColumnRenamed("key", key)


def _hash(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def form_keys(texts: DataFrame, key: str, column: str, canon: Canon) -> DataFrame:
    """(key, form, raw) with 128-bit digests of the form and the raw text of each non-empty text; texts do not come back from the tasks' Python."""

    def run(batches):
        for batch in batches:
            raws = batch.column(1).to_pylist()
            a = [_hash(t) for t in raws]
            b = []
            for t, h in zip(raws, a):
                form = canon.text(t)
                b.append(h if form is t else _hash(form))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b, pa.binary()), pa.array(a, pa.binary())], names=["key", "form", "raw"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, column).where(F.col(column).isNotNull() & (F.col(column) != "")).mapInArrow(run, f"key {kind}, form binary, raw binary")


def look_groups(texts: DataFrame, key: str = "doc_id", column: str = "text", canon: Canon | None = None) -> DataFrame:
    """(key, form, raw): the texts whose form is shared by at least one other string.

    form and raw are digests of 128 bits. Exact copies alone make no group. Null
    and empty texts take no part.
    """
    canon = canon or vocabulary(texts, column)
    keys = cut(form_keys(texts, key, column, canon), "forms")
    shared = keys.groupBy("form").agg(F.min("raw").alias("_a"), F.max("raw").alias("_b")).where("_a != _b").select(F.col("form").alias("_form"))
    return keys.join(shared, keys.form == shared._form, "left_semi").withColumnRenamed("key", key)


def look_pairs(texts: DataFrame, key: str = "doc_id", column: str = "text", canon: Canon | None = None) -> DataFrame:
    """Pairs (key_a < key_b) of texts that look the same but are not the same string.

    The strings of one form are paired first, once each; the rows that hold them
    are joined to those pairs by string, so a string with many copies meets
    neither itself nor a group in one task.
    """
    rows = cut(look_groups(texts, key, column, canon), "looks")
    strings = rows.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    other = strings.select(F.col("form").alias("_form"), F.col("raw").alias("raw_b"))
    pairs = strings.join(other, strings.form == other._form).where("raw < raw_b").select(F.col("raw").alias("raw_a"), "raw_b")
    a, b = rows.select(F.col("raw").alias("raw_a"), F.col(key).alias("_a")), rows.select(F.col("raw").alias("raw_b"), F.col(key).alias("_b"))
    out = pairs.join(a, "raw_a").join(b, "raw_b")
    return out.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"))
