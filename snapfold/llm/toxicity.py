"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine over a block-max inverted index.

Terms are words and their beginnings, all that the examples have, known by their 64-bit hashes. Those that tell toxic
examples from others weigh more. The index holds the examples' vectors in blocks of like ones; per block and term it knows
the largest weight, so a query leaves out the blocks that cannot change its neighbours. Neighbours vote with their cosine; votes are calibrated on examples that are not in the index.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.rows import SLICE_ROWS, text_function, written
from snapfold.session import work_folder

#: Labelled rows of each class that are learnt from, about.
EXAMPLES = 12_000
#: The weight of a term that does not tell toxic examples from others, and the odds and the certainty (log odds by their
#: standard error: from, to) that give it weight 1.
LEAST_WEIGHT, FULL_ODDS, CERTAIN = 0.05, 8.0, (2.0, 4.0)
#: Neighbours that vote, and the weight of the base rate beside them.
NEIGHBOURS, PRIOR_WEIGHT = 15, 3.0
#: Examples in a block of the index, at most.
BLOCK = 1024
#: Groups of like examples, the most common terms that tell them apart, and rounds of finding them.
GROUPS, TOLD_BY, ROUNDS = 8, 256, 6
#: Terms that this share of a block's examples has are held densely, which is faster.
DENSE_SHARE = 1 / 16
#: Queries whose lists are summed together.
TOGETHER = 16
#: Rounding of sums in single precision, as a share of them.
ROUNDING = 1e-4
#: Every so-manieth example is kept for calibration.
CALIBRATE_EVERY = 5
#: From this score on a text is called toxic.
TOXIC_FROM = 0.3
REMEMBERED = 100_000
#: Values that are looked at together while groups are found.
PART = 1_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BEGINNINGS = (4, 6)
NO_TERMS = np.zeros(0, np.int32), np.zeros(0, np.int64)


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in _BEGINNINGS if len(word) > n)]


def sketch(text: str) -> int:
    """The least hash of the text's runs of five words: near copies mostly share it."""
    words = _WORD.findall(text.lower())
    runs = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return min(map(xxhash.xxh64_intdigest, runs)) >> 1


def hashes_of(word: str) -> list[int]:
    return [xxhash.xxh64_intdigest(t) >> 1 for t in terms_of(word)]


def telling(toxic: np.ndarray, others: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Weight of each term from the toxic examples and the others that have it: ``LEAST_WEIGHT`` to 1."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((others + 0.5) / (n_other + 1))
    sure = (odds / np.sqrt(1 / (toxic + 0.5) + 1 / (others + 0.5)) - CERTAIN[0]) / (CERTAIN[1] - CERTAIN[0])
    return LEAST_WEIGHT + (1 - LEAST_WEIGHT) * np.clip(odds / math.log(FULL_ODDS), 0, 1) * np.clip(sure, 0, 1)


class Vectoriser:
    """Texts -> terms (places in the sorted hashes of the vocabulary) and counts; remembers what the words it has seen hold."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: list[str]) -> None:
        if not len(self.vocabulary):
            self.known.update(dict.fromkeys(words, ()))
            return
        hashes = [hashes_of(w) for w in words]
        flat = np.array([h for hs in hashes for h in hs], dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        places, k = np.where(self.vocabulary[at] == flat, at, -1).tolist(), 0
        for word, hs in zip(words, hashes, strict=True):
            self.known[word] = tuple(p for p in places[k : k + len(hs)] if p >= 0)
            k += len(hs)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = _WORD.findall(text.lower())
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.learn(new)
        held = np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), dtype=np.int32)
        return np.unique(held, return_counts=True)


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one after another."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Block:
    """Examples that are like each other: weights of the block's common terms as a matrix, of the others as lists, and
    the largest weight of each term."""

    def __init__(self, cols: np.ndarray, places: np.ndarray, vals: np.ndarray, n_terms: int, size: int):
        order = np.argsort(cols, kind="stable")
        cols, places, vals = cols[order], places[order], vals[order].astype(np.float32)
        terms, first, counts = np.unique(cols, return_index=True, return_counts=True)
        self.size = size
        #: where each term of the vocabulary stands among the block's, 0 for those it lacks
        self.at = np.zeros(n_terms, dtype=np.int32)
        self.at[terms] = np.arange(1, len(terms) + 1)
        self.most = np.concatenate([[0], np.maximum.reduceat(vals, first) if len(terms) else []]).astype(np.float32)
        common = counts >= max(2.0, DENSE_SHARE * size)
        self.row = np.concatenate([[-1], np.where(common, np.cumsum(common) - 1, -1)]).astype(np.int32)
        dense = np.repeat(common, counts)
        self.dense = np.zeros((int(common.sum()), size), dtype=np.float32)
        self.dense[np.repeat(self.row[1:], counts)[dense], places[dense]] = vals[dense]
        self.places, self.vals = places[~dense].astype(np.int32), vals[~dense]
        self.starts = np.cumsum(np.concatenate([[0, 0], np.where(common, 0, counts)]))

    def bounds(self, terms: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """What no example of the block can score more than, of each of ``n`` queries laid end to end."""
        return np.bincount(owner, weights * self.most[self.at[terms]], n)

    def scores(self, terms: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Per query and example, the sum of weight times weight."""
        at = self.at[terms]
        row = self.row[at]
        common, rare = row >= 0, (row < 0) & (at > 0)
        asked = np.zeros((n, len(self.dense)), dtype=np.float32)
        asked[owner[common], row[common]] = weights[common]
        out = asked @ self.dense
        at, weights, owner = at[rare], weights[rare].astype(np.float32), owner[rare]
        a, b = self.starts[at], self.starts[at + 1]
        cuts = np.searchsorted(owner, np.arange(0, n + TOGETHER, TOGETHER))
        for k, low, high in zip(range(0, n, TOGETHER), cuts.tolist(), cuts[1:].tolist(), strict=False):
            if low < high:
                x, y = a[low:high], b[low:high]
                lists = ranges(x, y)
                place = self.places[lists] + np.repeat((owner[low:high] - k) * self.size, y - x)
                part = out[k : k + TOGETHER]
                sums = np.bincount(place, self.vals[lists] * np.repeat(weights[low:high], y - x), part.size)
                part += sums.reshape(part.shape)
        return out


def alike(cols: np.ndarray, rows: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
    """A group for each of ``n`` examples: k-means by cosine over the most common terms."""
    counts = np.bincount(cols)
    common = np.argsort(-counts, kind="stable")[:TOLD_BY]
    place = np.full(len(counts), -1, dtype=np.int32)
    place[common] = np.arange(len(common))
    told = np.zeros((n, len(common)), dtype=np.float32)
    for k in range(0, len(cols), PART):
        at = place[cols[k : k + PART]]
        told[rows[k : k + PART][at >= 0], at[at >= 0]] = vals[k : k + PART][at >= 0]
    told /= np.maximum(np.linalg.norm(told, axis=1, keepdims=True), 1e-9)
    centres = told[np.linspace(0, n - 1, min(n, GROUPS)).astype(np.int64)]
    for _ in range(ROUNDS):
        group = (told @ centres.T).argmax(axis=1)
        sums = np.vstack([told[group == g].sum(axis=0) for g in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return group


def tf_idf(terms, counts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their weights of length 1; nothing for no terms."""
    at = np.asarray(terms, dtype=np.int32)
    weight = (1 + np.log(np.asarray(counts, dtype=float))) * idf[at]
    return at, weight / max(float(np.sqrt((weight**2).sum())), 1e-12)


class BlockMaxIndex:
    """Examples as unit vectors, equal ones as one entry with summed weights.

    ``examples``: (doc_id, terms, weights, mass, toxic mass), gone through twice, so that each vector is held once. Blocks hold entries of one group of like examples, by
    length, so that their maxima are sharp. A query asks its most promising block first; of the others only those whose
    bound reaches the ``k``-th best score so far. ``scored`` and ``skipped`` count the entries of either kind.
    """

    def __init__(self, examples, n_terms: int):
        merged: dict = {}
        places = []
        for doc_id, terms, weights, mass, toxic in examples:
            key = xxhash.xxh128_digest(terms.tobytes() + np.round(weights, 12).tobytes())
            entry = merged.setdefault(key, [doc_id, len(terms), 0.0, 0.0, len(merged)])
            entry[0] = min(entry[0], doc_id)
            entry[2] += mass
            entry[3] += toxic
            places.append(entry[4])
        ids, sizes, mass, toxic = (
            np.array([e[k] for e in merged.values()], dtype=kind) for k, kind in enumerate((np.int64, np.int64, float, float))
        )
        n = len(merged)
        del merged
        ends = np.cumsum(np.concatenate([[0], sizes]))
        self.cols, self.vals = np.empty(ends[-1], dtype=np.int32), np.empty(ends[-1])
        for place, example in zip(places, examples, strict=True):
            own = slice(ends[place], ends[place + 1])
            self.cols[own], self.vals[own] = example[1], example[2]
        group = alike(self.cols, np.repeat(np.arange(n, dtype=np.int32), sizes), self.vals, n) if n else np.zeros(0, np.int64)
        order = np.lexsort((ids, sizes, group))
        self.ids, self.mass, self.toxic = ids[order], mass[order], toxic[order]
        self.low, self.high, self.query = ends[:-1][order], ends[1:][order], np.zeros(n_terms)
        self.scored = self.skipped = 0
        self.firsts, self.blocks = [], []
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1)).tolist() + [n]
        for start, end in zip(cuts, cuts[1:], strict=False):
            for k in range(start, end, BLOCK):
                last = min(k + BLOCK, end)
                at = ranges(self.low[k:last], self.high[k:last])
                places = np.repeat(np.arange(last - k, dtype=np.int32), sizes[order[k:last]])
                self.firsts.append(k)
                self.blocks.append(Block(self.cols[at], places, self.vals[at], n_terms, last - k))

    def exact(self, terms: np.ndarray, weights: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """The cosines with these entries, in double precision."""
        a, b = self.low[entries], self.high[entries]
        at = ranges(a, b)
        self.query[terms] = weights
        found = np.add.reduceat(self.query[self.cols[at]] * self.vals[at], np.cumsum(b - a) - (b - a))
        self.query[terms] = 0
        return found

    def best(self, terms: np.ndarray, weights: np.ndarray, entries: np.ndarray, k: int) -> list[tuple[float, int]]:
        scores = zip(np.round(self.exact(terms, weights, entries), 12).tolist(), entries.tolist(), strict=True)
        return sorted(((s, e) for s, e in scores if s > 0), key=lambda x: (-x[0], self.ids[x[1]]))[:k]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` entries of largest cosine above 0, as (cosine, entry); the smaller id first where equal."""
        return self.nearest_many([(terms, weights)], k)[0]

    def nearest_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        n = len(queries)
        out: list = [[] for _ in queries]
        if not len(self.ids) or not any(len(terms) for terms, _ in queries):
            return out
        terms, weights = (np.concatenate([q[side] for q in queries]) for side in (0, 1))
        owner = np.repeat(np.arange(n), [len(q[0]) for q in queries])
        bounds = np.vstack([block.bounds(terms, weights, owner, n) for block in self.blocks]) * (1 + ROUNDING)
        first = bounds.argmax(axis=0)
        scores, least = np.zeros((n, len(self.ids)), dtype=np.float32), np.zeros(n)
        for b, block in enumerate(self.blocks):
            asked = np.flatnonzero(first == b)
            own = self._score(b, asked, terms, weights, owner, scores)
            if block.size >= k and len(asked):
                least[asked] = np.partition(own, -k, axis=1)[:, -k]
        for b, block in enumerate(self.blocks):
            wanted = (first != b) & (bounds[b] >= least * (1 - ROUNDING)) & (bounds[b] > 0)
            self._score(b, np.flatnonzero(wanted), terms, weights, owner, scores)
            self.skipped += block.size * int((~wanted & (first != b)).sum())
        for q, found in enumerate(scores):
            last = np.partition(found, -k)[-k] if len(found) > k else 0.0
            # what is 0 shares no term, or lies in a block that was skipped
            near = np.flatnonzero((found >= last * (1 - ROUNDING)) & (found > 0))
            out[q] = self.best(*queries[q], near, k) if len(near) else []
        return out

    def _score(self, b: int, asked: np.ndarray, terms, weights, owner, scores: np.ndarray) -> np.ndarray:
        """The scores of block ``b`` for the queries ``asked``, also put into ``scores``."""
        if not len(asked):
            return scores[:0]
        number = np.full(len(scores), -1)
        number[asked] = np.arange(len(asked))
        held = number[owner]
        mine = held >= 0
        found = self.blocks[b].scores(terms[mine], weights[mine], held[mine], len(asked))
        scores[asked, self.firsts[b] : self.firsts[b] + self.blocks[b].size] = found
        self.scored += found.size
        return found

    def vote(self, neighbours: list[tuple[float, int]], base: float) -> float:
        """Toxic share of the neighbours, weighted by cosine and mass, with the base rate as one more voter."""
        mass, toxic = PRIOR_WEIGHT, PRIOR_WEIGHT * base
        for cosine, entry in neighbours:
            weight = cosine / self.mass[entry]
            mass += weight * self.mass[entry]
            toxic += weight * self.toxic[entry]
        return toxic / mass


def calibration(votes: np.ndarray, toxic: np.ndarray, mass: np.ndarray) -> list[tuple[float, float, float]]:
    """Rising steps from vote to probability, as (least vote, largest vote, probability): pooled adjacent violators."""
    pools: list[list[float]] = []  # least vote, mass, toxic mass, largest vote
    order = np.argsort(votes, kind="stable")
    for v, t, m in zip(votes[order].tolist(), toxic[order].tolist(), mass[order].tolist(), strict=True):
        if pools and pools[-1][0] == v:
            pools[-1][1] += m
            pools[-1][2] += m * t
        else:
            pools.append([v, m, m * t, v])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1][1:] = [pools[-1][1] + last[1], pools[-1][2] + last[2], last[3]]
    return [(p[0], p[3], p[2] / p[1]) for p in pools]


@dataclass
class ToxicityModel:
    weights: np.ndarray
    index: BlockMaxIndex
    base: float
    steps: list[tuple[float, float, float]]

    def judge_many(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """Score and the ids of the neighbours that speak for it, nearest first, of each of (terms, counts)."""
        found = self.index.nearest_many([tf_idf(t, c, self.weights) for t, c in vectors], NEIGHBOURS)
        return [(self.calibrated(self.index.vote(n, self.base)), [int(self.index.ids[e]) for _, e in n]) for n in found]

    def votes(self, examples: list[tuple[int, int, bytes]]) -> list[float]:
        """The votes on packed examples."""
        out: list[float] = []
        for k in range(0, len(examples), SLICE_ROWS):
            queries = [tf_idf(t, c, self.weights) for _, _, t, c in unpacked(examples[k : k + SLICE_ROWS])]
            out += [self.index.vote(near, self.base) for near in self.index.nearest_many(queries, NEIGHBOURS)]
        return out

    def calibrated(self, vote: float) -> float:
        """Probability of a vote. Between two steps it rises slowly at first, since few examples have such votes and the
        rarer class should not be called on them."""
        if not self.steps:
            return vote
        k = sum(1 for least, _, _ in self.steps if least <= vote) - 1
        if k < 0:
            return self.steps[0][2]
        _, top, value = self.steps[k]
        if vote <= top or k + 1 == len(self.steps):
            return value
        following, _, above = self.steps[k + 1]
        return value + (above - value) * ((vote - top) / (following - top)) ** 2


def labelled(labels: DataFrame, learn) -> DataFrame:
    """(doc_id, toxic) of the rows to learn from, a doubly labelled document once: toxic if any label says so."""
    return (
        labels.filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )


def sampled_labels(rows: DataFrame, examples: int) -> tuple[DataFrame, dict[int, float]]:
    """At most ``examples`` rows of each class by a hash of the id, and the rows that one of them stands for."""
    total = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    parts = [rows.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(examples) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), {c: max(1.0, total.get(c, 0) / examples) for c in (0, 1)}


def with_toxicity(docs: DataFrame, labels: DataFrame, learn, text: str = "text", *, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, score (0 to 1), neighbours (ids of the nearest examples, nearest first) of each row of ``docs``.

    ``learn`` is the condition on ``labels`` that says which rows may be learnt from. At most ``examples`` of each class
    are; all their terms count, and document frequencies come from all of ``docs``. A score depends on the text alone:
    equal texts score alike, and texts without a term of the examples, null and empty ones too, get what the calibration
    gives for no neighbour.
    """
    # the sample is at most 2 * examples short rows, small enough to broadcast
    chosen, stands_for = sampled_labels(labelled(labels, learn), examples)
    chosen = written(chosen, "toxic-labels")

    def make_terms():
        def run(texts):
            out = []
            for t in texts:
                string = t.decode() if t else ""
                counted: dict[int, int] = {}
                for w, n in words_of(string).items():
                    for h in hashes_of(w):
                        counted[h] = counted.get(h, 0) + n
                terms = sorted(counted)
                out.append({"terms": terms, "counts": [counted[h] for h in terms], "sketch": sketch(string)})
            kind = [("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("sketch", pa.int64())]
            return pa.array(out, pa.struct(kind))

        return run

    source = docs.select("doc_id", F.col(text).alias("text"))
    samples = source.join(F.broadcast(chosen), "doc_id")
    kind = "terms array<long>, counts array<int>, sketch long"
    told = samples.select("doc_id", "toxic", text_function(make_terms, kind)("text").alias("x"))
    told = written(told.select("doc_id", "toxic", "x.*"), "toxic-terms")
    # of near copies one counts as a case, at most one row for each example
    cases = written(told.groupBy("toxic", "sketch").agg(F.min("doc_id").alias("doc_id")).withColumn("case", F.lit(1)), "toxic-cases")
    n = {r[0]: r[1] for r in cases.groupBy("toxic").count().collect()}
    held = (
        told.join(F.broadcast(cases), ["toxic", "sketch", "doc_id"], "left")
        .select((F.col("toxic") * F.col("case")).alias("a"), ((1 - F.col("toxic")) * F.col("case")).alias("b"), F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
        .toArrow()
    )
    hashes, a, b = (held[c].to_numpy() for c in ("term", "a", "b"))
    order = np.argsort(hashes)
    vocabulary, weight = hashes[order], telling(a[order], b[order], n.get(1, 0), n.get(0, 0))
    del held, hashes, a, b, order
    # a task has one core, and threads that wait for others burn theirs
    docs.sparkSession.sparkContext.environment["OPENBLAS_NUM_THREADS"] = "1"
    token, broadcast = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast
    words = broadcast(zlib.compress(vocabulary.tobytes(), 1))

    def make_vectors():
        vectors = held_by_worker((token, "words"), lambda: Vectoriser(np.frombuffer(zlib.decompress(words.value), dtype=np.int64)))

        def run(texts):
            found = [vectors.counts(t.decode()) if t else NO_TERMS for t in texts]
            return pa.array([packed(t.astype(np.int32), c.astype(np.int32).tobytes()) for t, c in found], pa.binary())

        return run

    vectors = source.select("doc_id", text_function(make_vectors, "binary")("text").alias("vector"))
    path = work_folder(docs.sparkSession, "toxic-vectors")
    vectors.write.parquet(path)
    vectors = docs.sparkSession.read.schema(vectors.schema).parquet(path)
    n_terms = len(vocabulary)

    def document_frequencies(batches):
        """Per task, the rows (as term -1) and how many of them have each term."""
        seen, rows = np.zeros(n_terms, dtype=np.int64), 0
        for batch in batches:
            rows += len(batch)
            for k in range(0, len(batch), SLICE_ROWS):
                terms = [unpack(v)[0] for v in batch.column(0).slice(k, SLICE_ROWS).to_pylist()]
                seen += np.bincount(np.concatenate(terms), minlength=n_terms)
        some = np.flatnonzero(seen)
        yield pa.record_batch({"term": np.append(some, -1).astype(np.int32), "n": np.append(seen[some], rows)})

    per_task = vectors.select("vector").mapInArrow(document_frequencies, "term int, n long")
    frequency = per_task.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    weight *= inverse_frequencies(frequency["term"].to_numpy(), frequency["n"].to_numpy(), n_terms)
    learnt, aside, base = split(told, vocabulary, stands_for)
    shared = broadcast((learnt, aside, zlib.compress(weight.tobytes(), 1)))

    def build():
        examples, _, weights = shared.value
        weights = np.frombuffer(zlib.decompress(weights))
        return ToxicityModel(weights, BlockMaxIndex(Weighted(examples, weights, stands_for), len(weights)), base, [])

    @F.arrow_udf("double")
    def vote(places: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, left_out = held_by_worker((token, "model"), build), shared.value[1]
        for batch in places:
            yield pa.array(model.votes([left_out[k] for k in batch.to_pylist()]), pa.float64())

    places = docs.sparkSession.range(len(aside)).select("id", vote.asNondeterministic()("id").alias("vote"))
    votes = {r.id: r.vote for r in places.collect()}
    toxic = np.array([r[1] for r in aside], dtype=float)
    mass = np.array([stands_for[r[1]] for r in aside], dtype=float)
    steps = calibration(np.array([votes[k] for k in range(len(aside))], dtype=float), toxic, mass)

    @F.arrow_udf("score double, neighbours array<long>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held_by_worker((token, "model"), build)
        model.steps = steps
        for vectors in batches:
            out = []
            for k in range(0, len(vectors), SLICE_ROWS):
                keys = vectors.slice(k, SLICE_ROWS).to_pylist()
                known = list(dict.fromkeys(keys))
                judged = dict(zip(known, model.judge_many([unpack(v) for v in known]), strict=True))
                out += [dict(zip(("score", "neighbours"), judged[key], strict=True)) for key in keys]
            yield pa.array(out, pa.struct([("score", pa.float64()), ("neighbours", pa.list_(pa.int64()))]))

    return vectors.select("doc_id", judge.asNondeterministic()("vector").alias("j")).select("doc_id", "j.*")


_held: dict = {}


def held_by_worker(key: tuple[str, str], make):
    """What ``make`` gives, once for all tasks in a row that a worker process runs with it; only one such thing is held."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def inverse_frequencies(terms: np.ndarray, n: np.ndarray, n_terms: int) -> np.ndarray:
    """IDF of each term from how many rows have it; term -1 has the number of rows."""
    frequency = np.zeros(n_terms)
    frequency[terms[terms >= 0]] = n[terms >= 0]
    return np.log((1 + n[terms < 0].sum()) / (1 + frequency)) + 1


def packed(terms: np.ndarray, counts: bytes) -> bytes:
    """Rising terms and their counts (both int32) as a few bytes."""
    return zlib.compress(np.diff(terms, prepend=np.int32(0)).tobytes() + counts, 1)


def unpack(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = np.frombuffer(zlib.decompress(vector), dtype=np.int32).reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), counts


def unpacked(examples: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(doc_id, toxic, terms, counts) of each example."""
    for doc_id, toxic, vector in examples:
        yield doc_id, toxic, *unpack(vector)


@dataclass
class Weighted:
    """Packed examples as the index takes them, worked out anew each time they are gone through."""

    examples: list[tuple[int, int, bytes]]
    weight: np.ndarray
    mass: dict[int, float]

    def __iter__(self):
        for doc_id, toxic, terms, counts in unpacked(self.examples):
            if len(terms):
                yield doc_id, *tf_idf(terms, counts, self.weight), self.mass[toxic], self.mass[toxic] * toxic


def split(told: DataFrame, vocabulary: np.ndarray, stands_for: dict[int, float]):
    """The examples of the index (four fifths of all), those for the calibration, and the base rate. The driver holds
    the examples packed."""
    rows = []
    placed = told.select("doc_id", "toxic", "terms", "counts", F.xxhash64("doc_id").alias("place"))
    for r in placed.mapInArrow(_pack, "doc_id long, toxic int, place long, terms binary, counts binary").toLocalIterator():
        terms = np.searchsorted(vocabulary, np.frombuffer(r.terms, dtype=np.int64)).astype(np.int32)
        rows.append((r.place, r.doc_id, r.toxic, packed(terms, bytes(r.counts))))
    rows = [r[1:] for r in sorted(rows)]
    total = sum(stands_for[toxic] for _, toxic, _ in rows)
    base = sum(stands_for[1] for _, toxic, _ in rows if toxic == 1) / total if total else 0.0
    return [r for k, r in enumerate(rows) if k % CALIBRATE_EVERY], rows[::CALIBRATE_EVERY], base


def _pack(batches):
    """Lists of numbers as bytes, which the driver need not hold as objects."""
    for batch in batches:
        columns = {name: batch.column(name) for name in ("doc_id", "toxic", "place")}
        for name, kind in (("terms", np.int64), ("counts", np.int32)):
            lists = [np.asarray(x.values, dtype=kind).tobytes() for x in batch.column(name)]
            columns[name] = pa.array(lists, pa.binary())
        yield pa.record_batch(columns)
