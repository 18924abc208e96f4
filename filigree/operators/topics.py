"""Topics of texts: models, projections and prevalence over time."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.terms import entry_weights


def quarter_topics(rows: DataFrame, vec: str = "topic_vec", weight: str = "length") -> DataFrame:
    """(year, qtr, topic, weighted, unweighted, pairs): sums of topic values, by record length and plain; pairs counts (record, topic)."""
    flat = rows.select("year", "qtr", F.coalesce(F.col(weight), F.lit(0)).alias("_w"), F.explode(vec).alias("_e"))
    value = F.col("_e.val")
    return flat.groupBy("year", "qtr", F.col("_e.topic").alias("topic")).agg(F.sum(value * F.col("_w")).alias("weighted"), F.sum(value).alias("unweighted"), F.count(F.lit(1)).alias("pairs"))


def quarter_totals(rows: DataFrame, vec: str = "topic_vec", weight: str = "length") -> DataFrame:
    """(year, qtr, weights, docs) of the records that have topics."""
    return rows.where(F.size(vec) > 0).groupBy("year", "qtr").agg(F.sum(F.coalesce(F.col(weight), F.lit(0))).alias("weights"), F.count(F.lit(1)).alias("docs"))


def prevalence(rows: DataFrame, vec: str = "topic_vec", weight: str = "length") -> DataFrame:
    """(topic, year, weighted, unweighted): mean over a year's quarters of topic values per length and per record."""
    sums, totals = quarter_topics(rows, vec, weight), quarter_totals(rows, vec, weight)
    each = sums.join(totals, ["year", "qtr"])
    per = each.select("topic", "year", (F.col("weighted") / F.greatest(F.col("weights"), F.lit(1))).alias("w"), (F.col("unweighted") / F.greatest(F.col("docs"), F.lit(1))).alias("u"))
    return per.groupBy("topic", "year").agg(F.avg("w").alias("weighted"), F.avg("u").alias("unweighted"))


def top_words(weights: DataFrame, k: int = 50) -> DataFrame:
    """(topic, rank, word, weight): the k words of the largest weight for each topic, by sign, ties by word."""
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "word")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("topic", "rank", "word", "weight")


def top_topics(rows: DataFrame, key: str, vec: str = "topic_vec", k: int = 10) -> DataFrame:
    """(key, rank, topic, val): the k largest topics of each record, by sign, ties by topic; done within each row."""
    best = F.slice(F.array_sort(F.transform(vec, lambda e: F.struct((-e["val"]).alias("v"), e["topic"].alias("t")))), 1, k)
    return rows.select(key, F.posexplode(best).alias("_at", "_e")).select(key, (F.col("_at") + 1).alias("rank"), F.col("_e.t").alias("topic"), (-F.col("_e.v")).alias("val"))


def project(weights: DataFrame, topics: DataFrame, key: str = "doc_id", term: str = "term") -> DataFrame:
    """(key, topic, val): records' term weights times topics' word weights (topic, word, weight)."""
    both = weights.join(topics.select("topic", F.col("word").alias("_t"), F.col("weight").alias("_v")), F.col(term) == F.col("_t"))
    return both.groupBy(key, "topic").agg(F.sum(F.col("weight") * F.col("_v")).alias("val"))


#: Records that are multiplied at once, and the part of topics from which on a word's weights are held as a row of a matrix.
RECORDS, OFTEN = 512, 0.05


def _nearest(shared, k: int):
    """(key, rank, topic, val) of batches (key, entries): see nearest()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topic, word, weight, weigh = shared.value
        ids, column = np.unique(topic, return_inverse=True)
        encoded = word.dictionary_encode()
        names, code = encoded.dictionary, encoded.indices.to_numpy()
        # words of many topics by a matrix, of which there are few; the others by lists
        often = np.bincount(code, minlength=len(names)) >= OFTEN * len(ids)
        row = np.where(often, np.cumsum(often) - 1, -1)
        matrix, there = np.zeros((often.sum(), len(ids))), np.zeros((often.sum(), len(ids)), np.float32)
        matrix[row[code[often[code]]], column[often[code]]] = weight[often[code]]
        there[row[code[often[code]]], column[often[code]]] = 1
        seldom = np.flatnonzero(~often[code])
        seldom = seldom[np.argsort(code[seldom], kind="stable")]
        size = np.bincount(code[seldom], minlength=len(names))
        start = np.cumsum(size) - size
        if weigh:
            terms, idf = weigh
            of_term = pc.fill_null(pc.index_in(terms, value_set=names), -1).to_numpy(zero_copy_only=False)
        for batch in batches:
            for at in range(0, batch.num_rows, RECORDS):
                part = batch.slice(at, RECORDS)
                if weigh:
                    record, place, val = entry_weights(part.column(1), terms, idf)
                    mine = of_term[place]
                else:
                    sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                    flat = pc.list_flatten(part.column(1))
                    record, val = np.repeat(np.arange(len(sizes)), sizes), pc.struct_field(flat, 1).to_numpy(zero_copy_only=False)
                    mine = pc.fill_null(pc.index_in(pc.struct_field(flat, 0), value_set=names), -1).to_numpy(zero_copy_only=False)
                known = mine >= 0
                record, mine, val = record[known], mine[known], val[known]
                many = row[mine] >= 0
                left, has = np.zeros((part.num_rows, len(matrix))), np.zeros((part.num_rows, len(matrix)), np.float32)
                np.add.at(left, (record[many], row[mine[many]]), val[many])
                has[record[many], row[mine[many]]] = 1
                sums, seen = left @ matrix, has @ there > 0
                few = ~many
                times = size[mine[few]]
                entry = seldom[np.arange(times.sum()) + np.repeat(start[mine[few]] - (np.cumsum(times) - times), times)]
                cell = np.repeat(record[few], times) * len(ids) + column[entry]
                sums += np.bincount(cell, np.repeat(val[few], times) * weight[entry], sums.size).reshape(sums.shape)
                seen.reshape(-1)[cell] = True
                sums = np.trunc(sums * 1000 + np.copysign(0.5, sums)) / 1000 + 0.0
                sums[~seen] = -np.inf
                if len(ids) > k:
                    seen &= sums >= np.partition(sums, len(ids) - k, axis=1)[:, len(ids) - k, None]
                r, c = np.nonzero(seen)
                order = np.lexsort((c, -sums[r, c], r))
                r, c = r[order], c[order]
                ranks = np.bincount(r, minlength=part.num_rows)
                rank = np.arange(len(r)) - np.repeat(np.cumsum(ranks) - ranks, ranks) + 1
                r, c, rank = r[rank <= k], c[rank <= k], rank[rank <= k]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(rank, pa.int32()), pa.array(ids[c], pa.int32()), pa.array(sums[r, c])], names=["key", "rank", "topic", "val"])

    return run


def _summed(shared, slab: int):
    """(first, sums): topic values times counts of the words that are given, added up by a task in slabs of words; -0.0 where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names = shared.value
        sums = np.full((len(names), len(ids)), -0.0)
        for batch in batches:
            for at in range(0, batch.num_rows, RECORDS):
                part = batch.slice(at, RECORDS)
                (topic, vec), (term, counter) = ((pc.list_flatten(c), pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)) for c in part.columns)
                word = pc.index_in(pc.struct_field(term, 0), value_set=names)
                known = pc.and_(pc.is_valid(word), pc.is_valid(pc.struct_field(term, 1))).to_numpy(zero_copy_only=False)
                record, word = np.repeat(np.arange(len(counter)), counter)[known], pc.fill_null(word, 0).to_numpy(zero_copy_only=False)[known]
                n = pc.fill_null(pc.struct_field(term, 1), 0).to_numpy(zero_copy_only=False)[known]
                times = vec[record]
                entry = np.arange(times.sum()) + np.repeat((np.cumsum(vec) - vec)[record] - (np.cumsum(times) - times), times)
                column = np.searchsorted(ids, pc.struct_field(topic, 0).to_numpy(zero_copy_only=False))[entry]
                value = pc.struct_field(topic, 1).to_numpy(zero_copy_only=False)[entry] * np.repeat(n, times) + 0.0
                np.add.at(sums.reshape(-1), np.repeat(word, times).astype(np.int64) * len(ids) + column, value)
        for first in range(0, len(names), slab):
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([pa.compress(sums[first : first + slab].tobytes(), "lz4", asbytes=True)], pa.binary())], names=["first", "sums"])

    return run


def _spread(shared, slab: int):
    """(topic, word, weight) of slabs of sums, of which the same ones come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names = shared.value
        each = ((first, blob) for batch in batches for first, blob in zip(batch.column(0).to_pylist(), batch.column(1)))
        for first, same in itertools.groupby(each, key=lambda x: x[0]):
            shape = min(slab, len(names) - first), len(ids)
            total = np.full(shape, -0.0)
            for _, blob in same:
                total += np.frombuffer(pa.decompress(blob.as_buffer(), total.nbytes, "lz4")).reshape(shape)
            w, t = np.nonzero((total != 0) | ~np.signbit(total))
            yield pa.RecordBatch.from_arrays([pa.array(ids[t], pa.int32()), names.take(pa.array(w + first)), pa.array(total[w, t])], names=["topic", "word", "weight"])

    return run


def word_weights(rows: DataFrame, frequencies: DataFrame, vec: str = "topic_vec", column: str = "counter") -> DataFrame:
    """(topic, word, weight): sums over records of topic values times counts of words; frequencies is (term, df).

    Frequent words stand with all topics in all tasks, so each task adds them up in
    a table of HELD bytes; the others, which have few pairs, are shuffled.
    """
    flat = rows.where(f"{vec} is not null and {column} is not null").select(F.filter(vec, lambda e: e["topic"].isNotNull() & e["val"].isNotNull()).alias("_v"), column)
    ids = np.array(sorted(r[0] for r in flat.select(F.explode("_v.topic")).distinct().collect()), np.int32)
    frequent = frequencies.orderBy(F.desc("df"), "term").limit(max(1, HELD // (8 * max(1, len(ids))))).select("term").toArrow().column(0).combine_chunks()
    spark = rows.sparkSession
    shared, slab = spark.sparkContext.broadcast((ids, frequent)), max(1, (1 << 20) // (8 * max(1, len(ids))))
    tasks = spark.sparkContext.defaultParallelism
    parts = flat.select("_v", F.map_entries(column)).coalesce(tasks).mapInArrow(_summed(shared, slab), "first int, sums binary")
    held = parts.repartition(4 * tasks, "first").sortWithinPartitions("first").mapInArrow(_spread(shared, slab), "topic int, word string, weight double")
    names = spark.createDataFrame(pa.table({"_t": frequent}))
    rest = flat.select("_v", F.explode(column).alias("word", "_n")).join(F.broadcast(names), F.col("word") == F.col("_t"), "left_anti")
    rest = rest.select(F.explode("_v").alias("_e"), "word", "_n").groupBy(F.col("_e.topic").alias("topic"), "word").agg(F.sum(F.col("_e.val") * F.col("_n")).alias("weight"))
    return held.unionByName(rest)


def nearest(records: DataFrame, words: DataFrame, key: str, k: int = 10, frequencies: DataFrame | None = None, documents: int = 0) -> DataFrame:
    """(key, rank, topic, val): the k topics (topic, word, weight) that are largest for each record, of project() rounded to three decimals, by sign, ties by topic.

    records is (key, entries), one row a record: array of (term, weight), or, with
    `frequencies` (term, df), a map of term to count that is weighed as by tfidf().
    Topics, and frequencies if given, go to all tasks; each record is done within
    its row and of its topics only k leave the task.
    """
    held = words.where("word is not null and weight is not null").select("topic", "word", "weight").toArrow()
    weigh = None
    if frequencies is not None:
        found = frequencies.select("term", "df").toArrow()
        weigh = found.column(0).combine_chunks(), np.log2(documents / found.column(1).to_numpy())
    shared = records.sparkSession.sparkContext.broadcast((held.column(0).to_numpy(), held.column(1).combine_chunks(), held.column(2).to_numpy(), weigh))
    kind = dict(records.dtypes)[key]
    entries = F.map_entries("entries") if weigh else F.col("entries")
    return records.select(key, entries).mapInArrow(_nearest(shared, k), f"key {kind}, rank int, topic int, val double").withColumnRenamed("key", key)


#: Pairs of words that are made at once, bytes of the rows of the matrix that go together, and of those that a task adds up.
PAIRS, SLAB, HELD = 1 << 19, 8 << 20, 64 << 20
#: Vectors by which the search for the leading ones grows, and by how many at most over k it holds.
BLOCK, BEYOND = 100, 700
#: Residual, as a part of the largest value, at which a vector counts as found.
CLOSE = 1e-9


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sizes, idx, val): the records of a batch as three arrays."""
    for batch in batches:
        column = batch.column(0)
        flat = pc.list_flatten(column)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int32)
        arrays = sizes, pc.struct_field(flat, 0).to_numpy(zero_copy_only=False).astype(np.int32), pc.struct_field(flat, 1).to_numpy(zero_copy_only=False).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=["sizes", "idx", "val"])


def _pairs(words: int, slab: int, first: int, last: int):
    """(slab, sums): sums over records of products of two words, the upper triangle, for the rows from first to last in slabs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((last - first, words - first))
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, index, value = (np.frombuffer(c[k].as_buffer(), kind) for c, kind in zip(batch.columns, (np.int32, np.int32, np.float64)))
                mine = np.flatnonzero((index >= first) & (index < last))
                # every entry with those from itself on in its record, which come in order of the words
                partners = np.repeat(np.cumsum(sizes, dtype=np.int64), sizes)[mine] - mine
                sofar = np.cumsum(partners)
                at = 0
                while at < len(mine):
                    end = max(at + 1, int(np.searchsorted(sofar, (sofar[at - 1] if at else 0) + PAIRS, "right")))
                    many = partners[at:end]
                    a = np.repeat(mine[at:end], many)
                    b = a + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
                    np.add.at(gram.reshape(-1), (index[a] - first).astype(np.int64) * (words - first) + index[b] - first, value[a] * value[b])
                    at = end
        for start in range(first, last, slab):
            rows = gram[start - first : min(start + slab, last) - first, start - first :]
            yield pa.RecordBatch.from_arrays([pa.array([start], pa.int32()), pa.array([pa.compress(rows.tobytes(), "lz4", asbytes=True)], pa.binary())], names=["slab", "sums"])

    return run


def _rows(words: int, slab: int, start: int, blob: pa.BinaryScalar) -> np.ndarray:
    """Rows of the matrix, from the column of the first of them on."""
    rows, columns = min(slab, words - start), words - start
    return np.frombuffer(pa.decompress(blob.as_buffer(), rows * columns * 8, "lz4")).reshape(rows, columns)


def _added(words: int, slab: int):
    """Sums of the same slab, which come one after the other, in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((start, blob) for batch in batches for start, blob in zip(batch.column(0).to_pylist(), batch.column(1)))
        for start, same in itertools.groupby(each, key=lambda x: x[0]):
            total = np.zeros((min(slab, words - start), words - start))
            for _, blob in same:
                total += _rows(words, slab, start, blob)
            yield pa.RecordBatch.from_arrays([pa.array([start], pa.int32()), pa.array([pa.compress(total.tobytes(), "lz4", asbytes=True)], pa.binary())], names=["slab", "sums"])

    return run


def _times(words: int, slab: int, shared):
    """(part): the product of a task's rows of the matrix, both triangles, with vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.frombuffer(shared.value).reshape(words, -1)
        out = np.zeros(vectors.shape)
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _rows(words, slab, start, blob)
                end = start + len(rows)
                out[start:end] += rows @ vectors[start:]
                out[start:] += rows.T @ vectors[start:end]
                out[start:end] -= rows.diagonal()[:, None] * vectors[start:end]
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

    return run


def _told(words: int, shared):
    """(topic, word_id, weight): the vectors of topics, word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.frombuffer(shared.value).reshape(-1, words)
        ids = pa.array(np.arange(words, dtype=np.int32))
        for batch in batches:
            for topic in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(words, topic, np.int32)), ids, pa.array(vectors[topic])], names=["topic", "word_id", "weight"])

    return run


def leading(times: Callable[[np.ndarray], np.ndarray], n: int, k: int, block: int, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns): the k largest of a positive symmetric matrix of n rows, of which only its product with a block of vectors is asked.

    Block Lanczos with full orthogonalisation that is restarted from the best vectors
    so far, until each of the k leaves a residual of CLOSE times the largest value
    at most. It holds n times k + beyond + block numbers; these are n at most.
    """
    most = k + beyond
    draw = np.random.default_rng(0)
    held, small = np.empty((n, most + block)), np.zeros((most + block, most + block))
    held[:, :block] = np.linalg.qr(draw.standard_normal((n, block)))[0]
    fresh, have = 0, block
    while True:
        basis = held[:, :have]
        left = times(np.ascontiguousarray(held[:, fresh:have]))
        part = basis.T @ left
        left -= basis @ part
        again = basis.T @ left
        left -= basis @ again
        small[:have, fresh:have] = part + again
        small[fresh:have, :have] = small[:have, fresh:have].T
        new, rest = np.linalg.qr(left)
        if have + block > most or have >= k and not (have - k) % (3 * block):
            values, turn = np.linalg.eigh((small[:have, :have] + small[:have, :have].T) / 2)
            values, turn = values[::-1], np.ascontiguousarray(turn[:, ::-1])
            far = np.linalg.norm(rest @ turn[fresh:have, :k], axis=0)
            done = have >= k and far.max() <= CLOSE * max(values[0], 0)
            if done or have + block > most:
                keep = k if done else k + (most - k) // 2
                for at in range(0, n, 4096):  # in place
                    held[at : at + 4096, :keep] = held[at : at + 4096, :have] @ turn[:, :keep]
                if done:
                    return values[:k], held[:, :k].copy()
                small[:] = 0
                small[range(keep), range(keep)] = values[:keep]
                have = keep
        # directions that are used up make room for any others
        size = np.abs(rest.diagonal())
        spent = size <= 1e-13 * max(np.abs(small).max(), 1e-300)
        new[:, spent] = draw.standard_normal((n, int(spent.sum())))
        for _ in range(2):
            new -= held[:, :have] @ (held[:, :have].T @ new)
            new = np.linalg.qr(new)[0]
        held[:, have : have + block] = new
        fresh, have = have, have + block


def lsi(bow: DataFrame, words: int, k: int, tasks: int | None = None) -> tuple[list[float], DataFrame]:
    """(singular values, topics): latent semantic indexing of bags (bow: array of (idx, val) by idx) over `words` columns.

    Records are computed once, whatever k. Tasks, `tasks` at least (as many as run at
    once if not given), add up products of words that stand together, each for a
    group of rows of the matrix, words squared, that it can hold; the sums lie in a
    table. A matrix of few words comes to the driver to be taken apart; of a
    larger one the driver holds vectors only, by which the tasks multiply it.
    topics is (topic, word_id, weight). Signs of vectors are arbitrary; values of
    zero are left out.
    """
    from filigree.store import cut, discard

    spark = bow.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    records = cut(bow.select("bow").mapInArrow(_packed, "sizes binary, idx binary, val binary"), "records")
    slab = max(1, min(128, SLAB // (8 * max(words, 1))))
    bounds = [0]
    while bounds[-1] < words:
        bounds.append(min(words, bounds[-1] + slab * max(1, HELD // (8 * (words - bounds[-1]) * slab))))
    if not words:
        return [], spark.createDataFrame([], "topic int, word_id int, weight double")
    # as many tasks to a group as keep all busy, since each gives sums of the size of the group; a union of single partitions would be one task
    each = records.coalesce(max(2, -(-tasks // (len(bounds) - 1))))
    parts = [each.mapInArrow(_pairs(words, slab, first, last), "slab int, sums binary") for first, last in itertools.pairwise(bounds)]
    sums = functools.reduce(DataFrame.unionAll, parts).repartition(4 * tasks, "slab").sortWithinPartitions("slab").mapInArrow(_added(words, slab), "slab int, sums binary")
    sums = cut(sums, "products")
    discard(records)
    if words <= 2 * (k + BEYOND):
        gram = np.zeros((words, words))
        for start, blob in sums.toLocalIterator():
            rows = _rows(words, slab, start, pa.scalar(bytes(blob)))
            gram[start : start + len(rows), start:] = rows
        squares, vectors = np.linalg.eigh(gram, UPLO="U")
        squares, vectors = squares[::-1][:k], vectors[:, ::-1][:, :k]
    else:

        def times(block: np.ndarray) -> np.ndarray:
            shared = spark.sparkContext.broadcast(block.tobytes())
            out = np.zeros(block.shape)
            for part in sums.coalesce(tasks).mapInArrow(_times(words, slab, shared), "part binary").toArrow().column(0):
                out += np.frombuffer(part.as_buffer()).reshape(block.shape)
            shared.destroy()
            return out

        squares, vectors = leading(times, words, k, BLOCK, BEYOND)
    discard(sums)
    values = np.sqrt(np.maximum(squares, 0))
    values = values[values > 1e-9 * values[:1].max(initial=0)]
    found = len(values)
    shared = spark.sparkContext.broadcast(vectors[:, :found].T.tobytes())
    each = spark.range(0, found, 1, max(1, min(found, tasks))).mapInArrow(_told(words, shared), "topic int, word_id int, weight double")
    return values.tolist(), each


def lda(counts: DataFrame, vocabulary: DataFrame, key: str, k: int = 20, iterations: int = 10, seed: int = 0, term: str = "stem") -> DataFrame:
    """(topic, term, weight): latent Dirichlet allocation of records' counts (key, term, cnt), online over mini-batches.

    Sparse vectors are made in the JVM from the words of the vocabulary, which the
    model holds as a whole.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel

    from filigree.store import cut, discard

    words = [r[0] for r in vocabulary.select(term, "word_id").orderBy("word_id").select(term).toLocalIterator()]
    if not words:
        return vocabulary.sparkSession.createDataFrame([], f"topic int, {term} string, weight double")
    records = counts.groupBy(key).agg(F.flatten(F.collect_list(F.array_repeat(F.col(term), F.col("cnt").cast("int")))).alias("_words"))
    vectors = CountVectorizerModel.from_vocabulary(words, inputCol="_words", outputCol="features").transform(records).select("features")
    # written once: each mini-batch reads the records again
    held = cut(vectors, "features")
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online").fit(held)
    best = model.describeTopics(len(words))
    out = best.select("topic", F.arrays_zip("termIndices", "termWeights").alias("_z")).select("topic", F.explode("_z").alias("_e")).select("topic", F.col("_e.termIndices").alias("word_id"), F.col("_e.termWeights").alias("weight"))
    out = cut(out, "topics")
    discard(held)
    return out.join(vocabulary.select("word_id", term), "word_id").select("topic", term, "weight")
