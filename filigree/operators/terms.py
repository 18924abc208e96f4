"""Terms of texts: sentences, kept tokens and lemmas, n-grams, stems, vocabularies and their counts.

The analyser is a small set of rules in native expressions. It stands where the
source system had a statistical model: the shapes of its results are the same,
lemmas, part-of-speech choices and entities are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree import result
from filigree.functions.collections import ngrams

# Words that are no terms.
STOP_WORDS = tuple(
    "a about after all also an and any are as at be because been before being between both but by can could did do does during each for from further had has have he her here his how if in into is it its may might more most must no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up us very was we were what when where which while who whom why will with would you your".split()
)
MAX_N = 3
KEPT_PART = 0.18


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"[.!?]+([ \n\t]|\z)", "\u0001"), "\u0001")


def lemma(word: Column) -> Column:
    """Lower case without plural endings."""
    low = F.lower(word)
    # both patterns need an s at the end, which few words have
    return F.when((F.length(low) > 4) & F.endswith(low, F.lit("s")), F.regexp_replace(F.regexp_replace(low, "ies$", "y"), "([^s])s$", "$1")).otherwise(low)


def kept_tokens(sentence: Column) -> Column:
    """Alphabetic tokens that are no stop words."""
    return F.filter(F.regexp_extract_all(sentence, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*STOP_WORDS))


def phrases(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, words): the kept tokens of each sentence that has any, as they stand."""
    sentence = texts.where(F.col(text).isNotNull()).select(*key, F.explode(sentences(F.col(text))).alias("_s"))
    return result.once(sentence, "words", kept_tokens(F.col("_s"))).select(*key, "words").where(F.size("words") > 0)


def lemmas_of(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, l): the lemmas of each sentence's kept tokens."""
    return result.once(phrases(texts, key, text), "l", F.transform("words", lemma))


def ngram_counts(texts: DataFrame, by: list[str], text: str = "text", n: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """(by, n, term, cnt): n-grams of lemmas within sentences, joined by a space; that of n = 0 is empty and counts all tokens.

    One aggregation, partial sums before the shuffle; by may be empty for the whole
    collection. Tokens are added up by sentence for n = 0.
    """
    found = lemmas_of(texts, by, text)

    def grams(k: int) -> Column:
        if not k:
            return F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("term"), F.size("l").cast("bigint").alias("_c")))
        return F.transform(ngrams(F.col("l"), k), lambda t: F.struct(F.lit(k).alias("n"), t.alias("term"), F.lit(1).cast("bigint").alias("_c")))

    return found.select(*by, F.inline(F.concat(*[grams(k) for k in n]))).groupBy(*by, "n", "term").agg(F.sum("_c").alias("cnt"))


TERM = ("kind", "n", "term", "word")


def all_terms(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, kind, n, term, word, cnt): everything that is counted of texts, in one table.

    kind is `entity`, `ngram` (n from 0 to 3) or `stem` (word is the surface form);
    n and word are null where they do not apply. by may name paragraphs, documents,
    quarters or nothing: sums of finer groups are those of coarser ones.
    """
    none, no_word = F.lit(None).cast("int"), F.lit(None).cast("string")
    entities = entity_counts(texts, by, text).select(*by, F.lit("entity").alias("kind"), none.alias("n"), "term", no_word.alias("word"), "cnt")
    grams = ngram_counts(texts, by, text).select(*by, F.lit("ngram").alias("kind"), "n", "term", no_word.alias("word"), "cnt")
    stems = stem_words(texts, by, text).select(*by, F.lit("stem").alias("kind"), none.alias("n"), F.col("stem").alias("term"), "word", "cnt")
    return entities.unionByName(grams).unionByName(stems)


def rolled_up(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of all_terms() for finer groups added up to coarser ones."""
    return counts.groupBy(*by, *TERM).agg(F.sum("cnt").alias("cnt"))


def paragraphs_of(sections: DataFrame, key: list[str], text: str = "text", least_chars: int = 1000) -> DataFrame:
    """(key, para_no, para): the lines of sections of enough characters."""
    return sections.where(F.length(text) > least_chars).select(*key, F.posexplode(F.split(text, "\n")).alias("para_no", "para"))


def entity_counts(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, term, cnt): runs of two or more capitalised words, lower case."""
    names = F.regexp_extract_all(F.col(text), F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0))
    return texts.select(*by, F.explode(names).alias("_e")).groupBy(*by, F.lower("_e").alias("term")).agg(F.count(F.lit(1)).alias("cnt"))


def stem_words(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, stem, word, cnt): surface forms of each lemma."""
    words = phrases(texts, by, text).select(*by, F.explode("words").alias("word"))
    return words.groupBy(*by, lemma(F.col("word")).alias("stem"), "word").agg(F.count(F.lit(1)).alias("cnt"))


def stems_of_maps(rows: DataFrame, by: list[str], column: str = "unstem_map") -> DataFrame:
    """(by, stem, word, cnt) added up from maps of stem to surface form to count."""
    outer = rows.select(*by, F.explode(column).alias("stem", "_m"))
    return outer.select(*by, "stem", F.explode("_m").alias("word", "_n")).groupBy(*by, "stem", "word").agg(F.sum("_n").alias("cnt"))


def stem_totals(rows: DataFrame, by: list[str], column: str = "counter") -> DataFrame:
    """(by, stem, cnt) added up from maps of stem to count."""
    return rows.select(*by, F.explode(column).alias("stem", "_n")).groupBy(*by, "stem").agg(F.sum("_n").alias("cnt"))


def top_per_group(counts: DataFrame, by: list[str], k: int, term: str = "term", cnt: str = "cnt") -> DataFrame:
    """The k most frequent terms of each group with their rank, ties by term; a limit on groups is pushed below the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(cnt), term)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stem_report(counts: DataFrame, k: int | None = 10) -> DataFrame:
    """(stem, words): the k most frequent surface forms of each stem, or all, as `word count` texts in order."""
    ranked = top_per_group(counts, ["stem"], k, "word") if k else counts
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "word")))
    return ranked.groupBy("stem").agg(F.array_join(F.transform(pairs, lambda p: F.concat(p["word"], F.lit(" "), (-p["c"]).cast("string"))), ",").alias("words"))


def most_frequent_word(counts: DataFrame) -> DataFrame:
    """(stem, word): the most frequent surface form, ties by word."""
    return counts.groupBy("stem").agg(F.min(F.struct((-F.col("cnt")).alias("c"), F.col("word").alias("w"))).alias("_m")).select("stem", F.col("_m.w").alias("word"))


def cut_vocabulary(totals: DataFrame, part: float = KEPT_PART, term: str = "stem") -> DataFrame:
    """(term, cnt, word_id): the most frequent part of all terms, ids from 0 in order of the terms.

    A vocabulary is far smaller than its collection; its terms are ranked by one
    sort over a range of counts, not in one task.
    """
    keep = F.floor(F.lit(part) * totals.count())
    placed = ranks(totals, [F.desc("cnt"), F.col(term)], "_place").where(F.col("_place") <= keep)
    return ranks(placed.drop("_place"), [F.col(term)], "word_id").withColumn("word_id", F.col("word_id") - 1).select(term, "cnt", "word_id")


def ranks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row in a global order, from 1: sorted by range, numbered in each range, offset by the ranges before.

    No row moves into one task; only the numbers of rows of the ranges are added up.
    """
    from filigree.store import cut

    sorted_rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    sizes = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # one row for each partition of the sort: as small as the number of tasks
    return sorted_rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")


def word_frequencies(totals: DataFrame, term: str = "stem") -> DataFrame:
    """(rank, term, cnt, log_rank, log_freq) by falling count; rank from 0."""
    total = totals.agg(F.sum("cnt")).first()[0] or 1
    placed = ranks(totals, [F.desc("cnt"), F.col(term)], "rank").withColumn("rank", F.col("rank") - 1)
    return placed.select("rank", term, "cnt", F.log1p(F.col("rank").cast("double")).alias("log_rank"), F.log1p(F.col("cnt") / F.lit(float(total))).alias("log_freq"))


def bags(counts: DataFrame, vocabulary: DataFrame, key: list[str], term: str = "term") -> DataFrame:
    """(key, bow): array of (idx, val) by idx for the terms of each record that are in the vocabulary (term, word_id)."""
    known = counts.join(vocabulary.select(F.col(term).alias("_t"), "word_id"), F.col(term) == F.col("_t"))
    pair = F.struct(F.col("word_id").cast("int").alias("idx"), F.col("cnt").cast("double").alias("val"))
    return known.groupBy(*key).agg(F.array_sort(F.collect_list(pair)).alias("bow"))


def without(counts: DataFrame, stops: DataFrame, term: str = "stem") -> DataFrame:
    """counts without the stop terms."""
    return counts.join(stops.select(F.col(term).alias("_t")), F.col(term) == F.col("_t"), "left_anti")


def tfidf(counts: DataFrame, documents: int, key: str = "doc_id", term: str = "term") -> DataFrame:
    """(key, term, weight): (1 + log2 tf) * log2(N / df), each record's weights scaled to length one.

    df comes from one aggregation and is joined back; records are scaled by another
    aggregation rather than by a window, so no record is sorted.
    """
    df = counts.groupBy(F.col(term).alias("_t")).agg(F.count(F.lit(1)).alias("_df"))
    raw = counts.join(df, F.col(term) == F.col("_t")).select(key, term, ((1 + F.log2(F.col("cnt").cast("double"))) * F.log2(F.lit(float(documents)) / F.col("_df"))).alias("_w"))
    norm = raw.groupBy(F.col(key).alias("_k")).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norm, F.col(key) == F.col("_k")).where("_norm > 0").select(key, term, (F.col("_w") / F.col("_norm")).alias("weight"))


def entry_weights(column: pa.Array, names: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, place of the term, weight) of the entries (key, value) of a batch of records whose term is in `names`, weighed as by tfidf()."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    place = pc.index_in(pc.struct_field(flat, 0), value_set=names)
    known = pc.and_(pc.is_valid(place), pc.fill_null(pc.greater(pc.struct_field(flat, 1), 0), False)).to_numpy(zero_copy_only=False)
    record = np.repeat(np.arange(len(sizes)), sizes)[known]
    place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False)[known]
    weight = (1 + np.log2(pc.fill_null(pc.struct_field(flat, 1), 1).to_numpy(zero_copy_only=False)[known].astype(np.float64))) * idf[place]
    norm = np.sqrt(np.bincount(record, weight * weight, len(sizes)))[record]
    full = norm > 0
    return record[full], place[full], weight[full] / norm[full]


def tfidf_bags(rows: DataFrame, vocabulary: DataFrame, documents: int, column: str = "counter", term: str = "stem") -> DataFrame:
    """(bow): for each record that has any, an array of (idx, val) by idx of the weights of tfidf() for terms of the vocabulary (term, df, word_id from 0).

    The vocabulary goes to all tasks, so records are weighed where they are read and nothing is shuffled.
    """
    held = vocabulary.orderBy("word_id").select(term, "df").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((held.column(0).combine_chunks(), np.log2(documents / held.column(1).to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = shared.value
        for batch in batches:
            record, place, weight = entry_weights(batch.column(0), names, idf)
            order = np.lexsort((place, record))
            sizes = np.bincount(record)
            pairs = pa.StructArray.from_arrays([pa.array(place[order], pa.int32()), pa.array(weight[order])], names=["idx", "val"])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[sizes > 0])]), pa.int32()), pairs)], names=["bow"])

    return rows.select(F.map_entries(column)).mapInArrow(run, "bow array<struct<idx:int,val:double>>")


def bigram_likelihood(counts: DataFrame, least: int = 1) -> DataFrame:
    """(first, second, cnt, score): log-likelihood ratio of bigrams against the independence of their words.

    counts: (n, term, cnt) with n = 0, 1 and 2 over one collection.
    """
    from filigree.store import cut

    counts = cut(counts, "ngrams")
    total = float(counts.where("n = 0").agg(F.sum("cnt")).first()[0] or 0)
    words = counts.where("n = 1").select(F.col("term").alias("_t"), F.col("cnt").alias("_c"))
    pairs = counts.where((F.col("n") == 2) & (F.col("cnt") >= least)).select(F.split_part("term", F.lit(" "), F.lit(1)).alias("first"), F.split_part("term", F.lit(" "), F.lit(2)).alias("second"), "cnt")
    both = pairs.join(words.select(F.col("_t").alias("first"), F.col("_c").alias("_a")), "first").join(words.select(F.col("_t").alias("second"), F.col("_c").alias("_b")), "second")
    n = F.lit(total)
    table = [(F.col("cnt"), F.col("_a"), F.col("_b")), (F.col("_b") - F.col("cnt"), n - F.col("_a"), F.col("_b")), (F.col("_a") - F.col("cnt"), F.col("_a"), n - F.col("_b")), (n - F.col("_a") - F.col("_b") + F.col("cnt"), n - F.col("_a"), n - F.col("_b"))]
    score = F.lit(0.0)
    for seen, row, column in table:
        score = score + F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)
    return both.select("first", "second", "cnt", (2 * score).alias("score"))


def paragraph_stems(sections: DataFrame, key: list[str], text: str = "text", least_chars: int = 1000, least_stems: int = 50) -> DataFrame:
    """(key, para_no, counter, length): of sections of enough characters the paragraphs of enough distinct stems, with the count of each."""
    words = paragraphs_of(sections, key, text, least_chars).select(*key, "para_no", F.explode(kept_tokens(F.col("para"))).alias("_w"))
    counts = words.groupBy(*key, "para_no", lemma(F.col("_w")).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.groupBy(*key, "para_no").agg(F.map_from_entries(F.collect_list(F.struct("_s", "_n"))).alias("counter"), F.sum("_n").alias("length"))
    return found.where(F.size("counter") > least_stems)


def quarter_statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, paragraphs, words, stems, forms): records with a counter, their lengths, and the distinct stems and surface forms of each group."""
    held = rows.where("counter is not null")
    sums = held.groupBy(*by).agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("length").alias("words"))
    # forms by stem are added up first, so distinct ones are counted from few rows
    forms = stems_of_maps(held, by)
    each = forms.groupBy(*by, "stem").agg(F.count(F.lit(1)).alias("_f")).groupBy(*by).agg(F.count(F.lit(1)).alias("stems"), F.sum("_f").alias("forms"))
    return sums.join(each, by)
