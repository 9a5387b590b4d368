"""Quality classifier from weak labels.

Several overlapping heuristics vote good, bad or nothing on a text. Expectation-maximisation over the patterns of
votes estimates how often each heuristic is right on good and on bad texts, and gives each pattern the probability
that its texts are good. A linear scorer over hashed words and word shapes is fitted to these probabilities on a
bounded sample and then scores every text, so it also reaches texts on which the heuristics abstain.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.rows import free_name, text_function

#: Hash buckets of the scorer.
BUCKETS = 1 << 13
#: Rows the scorer is fitted on, about. The votes and the model of the labellers cover all rows.
FIT_ROWS = 6_000
EM_ROUNDS = 100
#: A heuristic that finds a defect is wrong about this share of the good texts at most.
FALSE_ALARMS = 0.002
#: Words a task remembers the weight of.
REMEMBERED = 300_000
#: Texts with a lower score are rejected.
KEEP_FROM = 0.3

_MARKS = re.compile(rb"[#*$%&|<>!_~^]")


def _share(hits: int, n: int) -> float:
    return hits / n if n else 0.0


def _bad_from(value: float, limit: float) -> int:
    """A defect says bad; its absence says nothing."""
    return -1 if value >= limit else 0


def _marked_words(text, words):
    return _bad_from(_share(sum(1 for w in words if _MARKS.search(w)), len(words)), 0.3)


def _marks(text, words):
    return _bad_from(_share(len(text) - len(text.translate(None, b"#*$%&|<>!_~^")), len(words)), 0.3)


def _upper(text, words):
    upper = len(text) - len(text.translate(None, bytes(range(65, 91))))
    lower = len(text) - len(text.translate(None, bytes(range(97, 123))))
    return _bad_from(_share(upper, upper + lower), 0.5)


def _stutters(words) -> int:
    """Words equal to the one before."""
    return sum(map(eq, words, islice(words, 1, None)))


def _flows(words) -> bool:
    return _share(_stutters(words), len(words)) < 0.12


def _short_words(text, words):
    share = _share(sum(1 for w in words if len(w) <= 3), len(words))
    return 1 if share >= 0.1 and _flows(words) else 0


def _sentences(text, words):
    ends = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    return 1 if 0.03 <= _share(ends, len(words)) <= 0.5 and _flows(words) else 0


def _lone_marks(text, words):
    return _bad_from(_share(text.count(b" | ") + text.count(b"!! "), len(words)), 0.2)


def _repeats(text, words):
    lines = [x for x in text.split(b"\n") if x]
    return -1 if len(lines) >= 4 and 2 * len(set(lines)) < len(lines) else 0


def _stutter(text, words):
    return _bad_from(_share(_stutters(words), len(words)), 0.25)


def _lengths(text, words):
    return -1 if not 2 <= _share(len(text), len(words)) <= 25 else 0


def _no_words(text, words):
    return 0 if words else -1


LABELLERS: dict[str, Callable[[bytes, list[bytes]], int]] = {
    "marked_words": _marked_words,
    "marks": _marks,
    "upper": _upper,
    "short_words": _short_words,
    "sentences": _sentences,
    "lone_marks": _lone_marks,
    "repeats": _repeats,
    "stutter": _stutter,
    "lengths": _lengths,
    "no_words": _no_words,
}


def votes_of(text: bytes | None) -> str:
    """One letter per labeller: '+', '-' or '0'."""
    text = text or b""
    words = text.split()
    return "".join("0+-"[vote(text, words)] for vote in LABELLERS.values())


def votes(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    return docs.withColumn(out, text_function(lambda: lambda ts: pa.array([votes_of(t) for t in ts]), "string")(text))


class LabelModel:
    """Class prior and, per labeller and class, the probability of each vote; classes are (bad, good)."""

    def __init__(self, patterns: Counter, rounds: int = EM_ROUNDS):
        texts = sorted(patterns)
        n = np.array([patterns[p] for p in texts], dtype=float)
        v = np.array([["0+-".index(c) for c in p] for p in texts], dtype=int).reshape(len(texts), len(LABELLERS))
        good = np.where((v == 2).any(axis=1), 0.1, 0.9)
        for _ in range(rounds):
            self.prior, self.says = self._maximise(v, n, good)
            good = self._expect(v)
        self._known = dict(zip(texts, good.tolist(), strict=True))

    @staticmethod
    def _maximise(v, n, good):
        post = np.stack([1 - good, good])
        prior = (post * n).sum(axis=1) + 1.0
        says = np.stack([[(post * n * (v[:, j] == k)).sum(axis=1) for k in range(3)] for j in range(v.shape[1])])
        says = says + 1.0
        # a labeller is held to be better than chance: what it says of a class is no rarer there than elsewhere
        says = says / says.sum(axis=1, keepdims=True)
        says[:, 1, 1] = np.maximum(says[:, 1, 1], says[:, 1, 0])
        says[:, 2, 0] = np.maximum(says[:, 2, 0], says[:, 2, 1])
        says[:, 2, 1] = np.minimum(says[:, 2, 1], FALSE_ALARMS)
        return prior / prior.sum(), says / says.sum(axis=1, keepdims=True)

    def _expect(self, v):
        logs = np.log(self.prior)[None, :] + sum(np.log(self.says[j][v[:, j]]) for j in range(v.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def good(self, pattern: str) -> float:
        if pattern not in self._known:
            self._known[pattern] = float(self._expect(np.array([["0+-".index(c) for c in pattern]]))[0])
        return self._known[pattern]

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Per labeller: how often it says good of good texts and bad of bad ones, where it votes."""
        out = {}
        for j, name in enumerate(LABELLERS):
            right = self.says[j][1, 1] / (self.says[j][1, 1] + self.says[j][2, 1])
            out[name] = float(right), float(self.says[j][2, 0] / (self.says[j][1, 0] + self.says[j][2, 0]))
        return out


def label_model(voted: DataFrame, column: str) -> LabelModel:
    """From all rows of ``voted``; the driver gets one row per pattern of votes, at most 3 to the number of labellers."""
    return LabelModel(Counter({r[0]: r[1] for r in voted.groupBy(column).count().collect()}))


def shape(word: bytes) -> bytes:
    """Runs of capitals, small letters (or bytes beyond ASCII) and digits as one letter each, other bytes as they are."""
    return re.sub(rb"([Aa0])\1+", rb"\1", word.translate(_SHAPES))


_SHAPES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)


def buckets_of(word: bytes) -> tuple[int, int]:
    return zlib.crc32(word) % BUCKETS, zlib.crc32(b"\0" + shape(word)) % BUCKETS


#: The bucket of words equal to the one before.
_AGAIN = zlib.crc32(b"\0again") % BUCKETS


class _Weights(dict):
    """Word -> sum of the weights of its buckets."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        a, b = buckets_of(word)
        value = self[word] = float(self.weights[a] + self.weights[b])
        return value


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer; a row is its buckets, their shares of the words, and the target."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    bucket = np.concatenate([np.asarray(r[0], dtype=np.int64) for r in rows])
    value = np.concatenate([np.asarray(r[1], dtype=float) for r in rows])
    target = np.array([r[2] for r in rows])
    # either class has the same say, however rare it is
    share = np.array([max((1 - target).sum(), 1e-9), max(target.sum(), 1e-9)])
    balance = 0.5 * len(rows) * ((1 - target) / share[0] + target / share[1])
    squares, bias_square = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        score = bias + np.bincount(at, value * weights[bucket], len(rows))
        off = balance * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target)
        slope = np.bincount(bucket, value * off[at], BUCKETS) / len(rows) + 1e-6 * weights
        squares += slope**2
        weights = weights - 1.0 * slope / np.sqrt(squares)
        bias_square += off.mean() ** 2
        bias -= 0.2 * off.mean() / np.sqrt(bias_square)
    return weights, float(bias)


def _features(text: bytes | None) -> tuple[list[int], list[float]]:
    words = (text or b"").split()
    counts = Counter(b for w, n in Counter(words).items() for b in buckets_of(w) * n)
    if words:
        counts[_AGAIN] += _stutters(words)
    return list(counts), [c / len(words) for c in counts.values()]


def train(docs: DataFrame, text: str = "text", *, key: str = "doc_id", fit_rows: int = FIT_ROWS):
    """The label model over all rows and the scorer fitted on about ``fit_rows`` rows, chosen by a hash of ``key``."""
    name = free_name(docs, "votes")
    model = label_model(votes(docs.select(text), name, text), name)
    limit = int(fit_rows / max(docs.count(), 1) * (1 << 20)) + 1

    def make():
        def run(texts):
            out = []
            for t in texts:
                b, v = _features(t)
                packed = np.array(b, dtype=np.int32).tobytes(), np.array(v, dtype=np.float64).tobytes()
                out.append({"good": model.good(votes_of(t)), "buckets": packed[0], "shares": packed[1]})
            return pa.array(out, pa.struct([("good", pa.float64()), ("buckets", pa.binary()), ("shares", pa.binary())]))

        return run

    chosen = docs.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < limit).select(key, text)
    chosen = chosen.withColumn(name, text_function(make, "good double, buckets binary, shares binary")(text))
    # the limit only binds where ids are null or repeated
    chosen = chosen.orderBy(F.xxhash64(key), F.xxhash64(text)).select(name).limit(2 * fit_rows)
    rows = [
        (np.frombuffer(r[0].buckets, dtype=np.int32), np.frombuffer(r[0].shares, dtype=np.float64), r[0].good)
        for r in chosen.toLocalIterator()
    ]
    return model, fit_scorer([r for r in rows if len(r[0])])


def with_quality(docs: DataFrame, out: str, text: str = "text", *, key: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with a struct ``out``: votes, weak (probability of good from the votes), score (of the scorer, 0 to 1) and
    kept. A text is kept if the mean of the two is ``KEEP_FROM`` or more. Null, empty and wordless texts score 0.
    """
    model, (weights, bias) = train(docs, text, key=key, fit_rows=fit_rows)
    kind = pa.struct([("votes", pa.string()), ("weak", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])

    def make():
        weight = _Weights(weights)

        def verdict(text: bytes | None) -> dict:
            words, pattern = (text or b"").split(), votes_of(text)
            weak = model.good(pattern)
            score = 0.0
            if words:
                mean = bias + (sum(map(weight.__getitem__, words)) + weights[_AGAIN] * _stutters(words)) / len(words)
                score = float(1 / (1 + np.exp(-np.clip(mean, -30, 30))))
            return {"votes": pattern, "weak": weak, "score": score, "kept": bool(words) and (weak + score) / 2 >= KEEP_FROM}

        return lambda texts: pa.array([verdict(t) for t in texts], kind)

    return docs.withColumn(out, text_function(make, "votes string, weak double, score double, kept boolean")(text))


def good_rows(docs: DataFrame, text: str = "text", *, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text the classifier keeps."""
    name = free_name(docs, "quality")
    return with_quality(docs, name, text, key=key).filter(F.col(name)["kept"]).select(docs.columns)
