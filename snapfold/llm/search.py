"""Ranked lexical search as exact inner products: impact vectors in order of length, pruned by buckets and coordinates.

A score is the inner product of a query's term weights and a document's term impacts. With sqrt(weight) on either
side, Cauchy-Schwarz bounds it by the product of the two lengths, so documents are held in falling order of length and
cut into buckets. Waves of buckets, each larger than the one before, give every query a rising 50th best score; a
bucket whose longest vector cannot reach it is passed over, and once that holds for every query the search ends. Inside
a bucket the largest impact of each coordinate bounds what the terms not yet looked at can add: only postings of the
first terms are visited, and of the documents met there only those whose bound still reaches the threshold are
scored, in whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapfold.llm.decontaminate import normal_words
from snapfold.llm.rows import let_workers_import, text_function, written

#: Documents returned for a query.
TOP = 50
#: Characters of queries searched for at a time (their terms are what is broadcast); more are further rounds.
BLOCK_CHARS = 4_000_000
#: Documents of the first wave, and how many times as many each later one has.
FIRST_WAVE, WAVE_GROWTH = 20_000, 8
#: Steps of length per doubling at which waves are cut, and documents of a bucket inside a wave.
BUCKETS = 8
BUCKET_ROWS = 1_024
#: Bounds are doubles; they are lifted by more than what rounding can take away.
SLACK = 1 + 1e-9
_LAST = np.iinfo(np.int64).max  # stands for a missing id, which comes last

_VECTOR = pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
_IMPACTS = "doc_id long, length double, terms array<int>, impacts array<long>"
_HITS = "item int, doc_id long, score long"


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _vectors(vocabulary):
    """Column function: number of terms of a text, and the known ones among them with their counts."""

    def make():
        known = vocabulary.value

        def run(texts):
            sizes, terms, tfs = [], [], []
            for text in texts:
                words = normal_words(text or b"")
                hits = Counter(filter(known.__contains__, words))
                sizes.append(len(words))
                terms.append(np.array([known[w] for w in hits], np.int32))
                tfs.append(np.array(list(hits.values()), np.int64))
            columns = [pa.array(sizes, pa.int64()), lists(terms, pa.int32()), lists(tfs, pa.int64())]
            return pa.StructArray.from_arrays(columns, fields=list(_VECTOR))

        return run

    return text_function(make, "n long, terms array<int>, tfs array<long>")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the size of each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _holders(n_terms: int):
    """Per task: how many documents hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch.column(0))[0], minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(df[seen], pa.int64())], ["term", "df"])

    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf, n, n_docs: int, n_terms: int):
    """What a term that stands ``tf`` times in a document of ``n`` terms adds per unit of its weight."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _with_impacts(weights, n_docs: int, n_terms: int):
    """Impact vectors and their lengths; documents without a known term have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = weights.value.astype(np.float64)
        for batch in batches:
            ids, sizes = batch.column(0), batch.column(1).to_numpy()
            terms, lengths = _flat(batch.column(2))
            tfs, _ = _flat(batch.column(3))
            owner = np.repeat(np.arange(len(sizes)), lengths)
            impacts = impact(tfs, sizes[owner], n_docs, n_terms)
            squares = np.bincount(owner, weights=scale[terms] * impacts.astype(np.float64) ** 2, minlength=len(sizes))
            out = [ids, pa.array(np.sqrt(squares)), batch.column(2), _like(batch.column(2), impacts)]
            yield pa.record_batch(out, ["doc_id", "length", "terms", "impacts"]).filter(pa.array(squares > 0))

    return run


def _like(column: pa.ListArray, values: np.ndarray) -> pa.ListArray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values, pa.int64()))


# ---------------------------------------------------------------- one bucket


class Bucket:
    """Impact vectors of nearly the same length, with the documents of each term."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.ids, self.lengths, self.sizes, self.terms, self.impacts = ids, lengths, sizes, terms, impacts
        self.longest = float(lengths.max()) if len(lengths) else 0.0
        self.starts = np.cumsum([0, *sizes])
        order = np.argsort(terms, kind="stable")
        self.docs, self.held = np.repeat(np.arange(len(sizes)), sizes)[order], impacts[order]
        self.known, self.at = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.at[1:], len(order))
        self.most = np.maximum.reduceat(self.held, self.at) if len(order) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may score ``threshold`` or more, all of their scores, and the number of postings visited."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if self.longest * math.sqrt(float(weights.sum())) * SLACK < threshold or not len(self.known):
            return nothing
        place = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        here = self.known[place] == terms
        place, w = place[here], weights[here]
        order = np.argsort(-(w * self.most[place]), kind="stable")  # coordinates by what they can add
        place, w = place[order], w[order]
        after = np.append(np.cumsum((w * self.most[place])[::-1])[::-1], 0)  # by all coordinates from here on
        cone = np.sqrt(np.append(np.cumsum(w[::-1])[::-1], 0))  # length of the query from here on
        rest = np.minimum(after, cone * self.longest) * SLACK
        n_first = int(np.argmax(rest < max(threshold, 1)))  # the coordinates a document must touch; rest ends at 0
        first = range(n_first)
        if not n_first:
            return nothing
        rows = np.concatenate([self.docs[self.at[p] : self.ends[p]] for p in place[:n_first]])
        values = np.concatenate([self.held[self.at[p] : self.ends[p]] for p in place[:n_first]]).astype(np.float64)
        scale = np.concatenate([np.full(self.ends[place[k]] - self.at[place[k]], w[k], np.float64) for k in first])
        partial = np.bincount(rows, weights=scale * values, minlength=len(self.ids))
        used = np.bincount(rows, weights=scale * values * values, minlength=len(self.ids))
        left = np.sqrt(np.maximum(self.lengths**2 * SLACK - used, 0))
        bound = (partial + np.minimum(after[n_first], cone[n_first] * left)) * SLACK
        kept = np.flatnonzero((partial > 0) & (bound >= threshold))
        return kept, self.scores(kept, terms, weights), len(rows)

    def postings(self, terms: np.ndarray) -> int:
        place = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        return int((self.ends - self.at)[place[self.known[place] == terms]].sum()) if len(self.known) else 0

    def scores(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents, from their own vectors."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        flat = np.arange(int(sizes.sum())) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        place = np.minimum(np.searchsorted(terms, self.terms[flat]), len(terms) - 1)
        found = terms[place] == self.terms[flat]
        added = np.where(found, weights[place] * self.impacts[flat], 0)
        sums = np.concatenate([[0], np.cumsum(added)])
        return sums[ends] - sums[ends - sizes]


def _best(ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:top]
    return ids[order], scores[order]


def _hits(items: list[int], ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    doc = pa.array(ids, pa.int64(), mask=ids == _LAST)
    return pa.record_batch([pa.array(items, pa.int32()), doc, pa.array(scores, pa.int64())], ["item", "doc_id", "score"])


def _search(queries, thresholds: dict[int, int], top: int):
    """Search of a task's rows, bucket by bucket, for the queries that have a threshold; the best of each query.

    A row of item -1 tells how many postings of the queries' terms were visited (``doc_id``) of how many (``score``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of, weights = queries.value
        best = {q: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for q in thresholds}
        floor = dict(thresholds)
        visited = possible = 0
        buckets = (b.slice(k, BUCKET_ROWS) for b in batches for k in range(0, b.num_rows, BUCKET_ROWS))
        for batch in buckets:
            ids = batch.column(0).fill_null(_LAST).to_numpy()
            terms, sizes = _flat(batch.column(2))
            bucket = Bucket(ids, batch.column(1).to_numpy(), sizes, terms, _flat(batch.column(3))[0])
            for q in thresholds:
                mine = terms_of[q]
                rows, scores, n = bucket.search(mine, weights[mine], floor[q])
                visited, possible = visited + n, possible + bucket.postings(mine)
                if len(rows):
                    ids_, scores_ = _best(np.concatenate([best[q][0], ids[rows]]), np.concatenate([best[q][1], scores]), top)
                    best[q] = ids_, scores_
                    if len(ids_) == top:
                        floor[q] = max(floor[q], int(scores_[-1]))
        for q, (ids, scores) in best.items():
            keep = scores >= max(1, thresholds[q])
            if keep.any():
                ids, scores = ids[keep], scores[keep]
                yield _hits([q] * len(ids), ids, scores)
        yield _hits([-1], np.array([visited]), np.array([possible]))

    return run


# ---------------------------------------------------------------- search


def items_of(queries: DataFrame, part: int, parts: int) -> list[tuple[int, list[bytes]]]:
    """Ids and distinct terms of a block of the queries; all texts of an id are one query, rows without an id are none."""
    told = queries.select("item_id", F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    block = told.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
    terms: dict[int, set[bytes]] = {}
    for row in block.collect():
        terms.setdefault(row.item_id, set()).update(normal_words(row.text.encode()))
    return [(i, sorted(t)) for i, t in sorted(terms.items()) if t]


def _ordered(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> tuple[DataFrame | None, np.ndarray]:
    """Impact vectors written in falling order of length, and the weight of every term; None where no text has a term."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)
    vectors = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _vectors(known)(text).alias("v")).select("doc_id", "v.*")
    vectors = written(vectors, "vectors")
    n_docs, n_terms = vectors.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    if not n_docs:
        return None, weights
    held = vectors.select("terms").mapInArrow(_holders(len(vocabulary)), "term int, df long")
    for term, df in held.groupBy("term").agg(F.sum("df")).collect():
        weights[term] = term_weight(n_docs, df)
    shared = spark.sparkContext.broadcast(weights)
    impacts = vectors.filter(F.size("terms") > 0).mapInArrow(_with_impacts(shared, n_docs, n_terms), _IMPACTS)
    by_length = impacts.repartitionByRange(F.desc("length"), "doc_id").sortWithinPartitions(F.desc("length"), "doc_id")
    return written(by_length, "impacts"), weights


def waves(vectors: DataFrame) -> list[tuple[float, float]]:
    """Ranges of length (least, most), longest first: whole buckets, each wave ``WAVE_GROWTH`` times as many documents.

    A bucket spans an eighth of a doubling, so some hundreds of rows say how many documents lie where.
    """
    bucket = F.floor(F.log2("length") * BUCKETS).alias("bucket")
    sizes = vectors.groupBy(bucket).agg(F.count("*").alias("n"), F.min("length").alias("lo"), F.max("length").alias("hi"))
    found, n, wanted = [], 0, FIRST_WAVE
    for row in sorted(sizes.collect(), key=lambda r: -r.bucket):
        if n == 0:
            found.append((row.lo, row.hi))
        found[-1] = (row.lo, found[-1][1])
        n += row.n
        if n >= wanted:
            n, wanted = 0, wanted * WAVE_GROWTH
    return found


def _top(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_block(docs: DataFrame, items: list[tuple[int, list[bytes]]], doc_id: str, text: str, top: int) -> tuple[DataFrame, float]:
    """The best documents of the items, by place in the list, and the share of postings passed over."""
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    empty = spark.createDataFrame([], _HITS + ", rank int")
    vectors, weights = _ordered(docs, vocabulary, doc_id, text)
    if vectors is None:
        return empty, 0.0
    terms_of = [np.array([vocabulary[t] for t in terms], np.int32) for _, terms in items]
    reach = [math.sqrt(float(weights[t].sum())) for t in terms_of]
    queries = spark.sparkContext.broadcast((terms_of, weights))
    best, floor = empty, dict.fromkeys(range(len(items)), 0)
    visited = possible = 0
    for lo, hi in waves(vectors):
        live = {q: floor[q] for q in floor if reach[q] * hi * SLACK >= floor[q]}
        if not live:
            break
        bucket = vectors.filter(F.col("length").between(lo, hi))
        hits = written(bucket.mapInArrow(_search(queries, live, top), _HITS), "hits")
        counted = hits.filter("item = -1").agg(F.sum("doc_id"), F.sum("score")).first()
        visited, possible = visited + (counted[0] or 0), possible + (counted[1] or 0)
        best = written(_top(best.drop("rank").unionByName(hits.filter("item >= 0")), top), "best")
        for row in best.filter(F.col("rank") == top).collect():
            floor[row.item] = row.score
    return best, 1 - visited / possible if possible else 0.0


def with_ranks(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` highest-scoring rows of ``docs`` for every query, all if fewer score.

    ``queries`` has item_id and text. Equal scores rank by ascending ``doc_id`` (a whole number; rows without one last,
    repeated ones next to each other). Null, empty and wordless texts are in no result and in no statistic, queries
    without words have none. The queries are collected in blocks of about ``BLOCK_CHARS`` characters, each searched
    for in all of ``docs``.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    chars = queries.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    parts = -(-chars // BLOCK_CHARS) or 1
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in range(parts):
        items = items_of(queries, part, parts)
        if items:
            best, _ = _search_block(docs, items, doc_id, text, top)
            ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
            found = found.unionByName(best.join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    return found
