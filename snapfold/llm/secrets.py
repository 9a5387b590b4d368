"""Secrets in texts: three fixed patterns, and random-looking strings by two character Markov models.

The models are first-order chains over bytes, one of random strings and one of ordinary words. They are trained on
what the fixed patterns label in the corpus itself: values that a pattern marks as a secret are random strings, the
words around them and everywhere else are ordinary. A candidate is flagged where the mean log-likelihood ratio of
its transitions favours the random chain.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.rows import free_name, let_workers_import, text_function

#: The kinds in order, their patterns, and what a match needs.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A candidate for the models: a run of these, at least ``CANDIDATE`` long, with a letter in it.
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
CANDIDATE = 20
#: Nats per transition by which the random chain must be the likelier one.
MARGIN = 0.5
#: Added to every transition count.
SMOOTHING = 0.5

_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_LONG_HEX = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_LONG_RUN = bytes(0x78 if re.match(r"[A-Za-z0-9+/_=-]", chr(b)) and b < 128 else 0x20 for b in range(256))
#: Byte -> its state: letters, digits and signs of a run apart, 0 for anything else.
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_STATES = np.zeros(256, dtype=np.int64)
_STATES[[ord(c) for c in _ALPHABET]] = np.arange(1, len(_ALPHABET) + 1)
N = len(_ALPHABET) + 1


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in code points, in order.

    Cheap byte tests first tell whether a pattern can match at all; most texts end there.
    """
    lower = text.lower()
    kinds = [
        any(w in lower for w in _WORDS),
        b"AKIA" in text,
        b"x" * LEAST["hex"] in text.translate(_LONG_HEX),
    ]
    if not any(kinds):
        return []
    string, found = text.decode(), []
    if kinds[0]:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(string) if len(m[2]) >= LEAST["assign"]]
    if kinds[1]:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(string) if len(m[0]) >= LEAST["access"]]
    if kinds[2]:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(string) if len(m[0]) >= LEAST["hex"]]
    return sorted(found)


def values(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The secret itself in each base span."""
    return [ASSIGN.match(text, a)[2] if kind == 0 else text[a:b] for a, kind, b in spans]


def transitions(text: bytes) -> np.ndarray:
    """Counts of state pairs, flat; pairs that touch anything outside runs are not counted."""
    states = _STATES[np.frombuffer(text, dtype=np.uint8)]
    counts = np.bincount(states[:-1] * N + states[1:], minlength=N * N).reshape(N, N)
    counts[0, :] = counts[:, 0] = 0
    return counts.ravel()


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio (random against ordinary) of every transition, from all rows of ``docs``.

    Each partition sends at most two counts per pair of states, so the driver gets N * N * 2 rows after summing.
    """

    def count(batches):
        ordinary, random = np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)
        for batch in batches:
            for t in batch.column(0).cast(pa.large_binary()).to_pylist():
                if t:
                    ordinary += transitions(t)
                    if spans := base_spans(t):
                        of_secrets = transitions(" ".join(values(t.decode(), spans)).encode())
                        random += of_secrets
                        ordinary -= of_secrets
        for name, counts in (("random", random), ("ordinary", ordinary)):
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], ["model", "pair", "n"]
            )

    let_workers_import(docs.sparkSession)
    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "model string, pair long, n long")
    table = {name: np.zeros(N * N) for name in ("random", "ordinary")}
    for row in counted.groupBy("model", "pair").agg(F.sum("n").alias("n")).collect():
        table[row.model][row.pair] = max(row.n, 0)
    return log_ratio(table["random"], table["ordinary"])


def log_ratio(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    def chain(counts):
        inner = counts.reshape(N, N)[1:, 1:] + SMOOTHING
        return np.log(inner / inner.sum(axis=1, keepdims=True))

    ratio = np.zeros((N, N))
    ratio[1:, 1:] = chain(random) - chain(ordinary)
    return ratio


def is_random(run: str, ratio: np.ndarray) -> bool:
    if len(run) < CANDIDATE or not re.search("[A-Za-z]", run):
        return False
    states = _STATES[np.frombuffer(run.encode(), dtype=np.uint8)]
    return bool(ratio[states[:-1], states[1:]].mean() > MARGIN)


def pieces(a: int, b: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of a to b lies outside the spans."""
    out = []
    for start, end in sorted(spans):
        if start > a:
            out.append((a, min(start, b)))
        a = max(a, end)
    return out + [(a, b)] * (a < b)


def all_spans(text: bytes | None, ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """Base spans, and runs that the models call random, as (start, kind, end) in order. A run that is more than its base
    spans is judged whole, and if it is not random, by what lies outside them; spans may overlap."""
    if not text:
        return []
    found = base_spans(text)
    if b"x" * CANDIDATE in text.translate(_LONG_RUN):
        string, base, k = text.decode(), found, 0
        inside: list[tuple[int, int]] = []
        more = []
        for m in RUN.finditer(string):
            a, b = m.span()
            if b - a < CANDIDATE:
                continue
            inside = [x for x in inside if x[1] > a]
            while k < len(base) and base[k][0] < b:
                if base[k][2] > a:
                    inside.append((base[k][0], base[k][2]))
                k += 1
            left = pieces(a, b, inside)
            if left and is_random(m[0], ratio):
                more.append((a, 3, b))
            elif left != [(a, b)]:
                more += [(c, 3, d) for c, d in left if is_random(string[c:d], ratio)]
        found = sorted(base + more)
    return found


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def secret_spans(ratio: np.ndarray):
    """Column function: all spans of a text in order; none for null or empty texts."""

    def make():
        def run(texts):
            return pa.array(
                [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(t, ratio)] for t in texts], _TYPE
            )

        return run

    return text_function(make, "array<struct<kind:string,start:int,end:int>>")


def masked(docs: DataFrame, text: str = "text", *, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; null texts stay null. Spans that overlap are one."""
    ratio = train(docs, text)

    def make():
        def run(texts):
            out = []
            for t in texts:
                spans = all_spans(t, ratio)
                if spans:
                    string, parts, at = t.decode(), [], 0
                    for a, _, b in spans:
                        if a >= at:
                            parts += [string[at:a], mask]
                        at = max(at, b)
                    t = "".join([*parts, string[at:]]).encode()
                out.append(t)
            return pa.array(out, pa.binary()).cast(pa.string())

        return run

    name = free_name(docs, "masked")
    hidden = docs.withColumn(name, text_function(make, "string")(text))
    return hidden.select(*(F.col(name).alias(c) if c == text else F.col(c) for c in docs.columns))
