"""Spelling variants: pairs of frequent words one edit apart, found by Gram matrices of letter counts.

An inserted letter moves a word's letter counts by a squared distance of 1, a replaced one by 2. Words lie in blocks of
equal length and equal counts over ``GROUPS`` groups of letters; one edit leads from a block to itself, to a block
of its length with one group less and one more, or to one of the next length with one group more. Only such blocks
meet, as tiles of bounded size. Per pair of tiles NumPy multiplies the two letter-count matrices, extended so that the
product is the squared distance less the one that counts; where it is zero, the letters themselves are compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.llm.rows import let_workers_import, written

#: A word has so many letters at least, and stands in the corpus so often.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: Of the runs in a document, those whose hash this number divides lose a letter.
DROP_EACH = 31
#: Groups of letters whose counts name a block; letters are dealt to them by code point.
GROUPS = 6
#: Words of a tile, and letters of its words together, at most (but for one word of more).
TILE_WORDS, TILE_LETTERS = 2_048, 1 << 22
#: Distinct words a task counts before it hands them on.
HELD_WORDS = 1 << 17
#: Letters of candidate pairs that are compared at a time.
COMPARED_LETTERS = 1 << 24

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
# All letters of words: what is left of the two alphabets after A-Z is lower-cased.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


# ---------------------------------------------------------------- words


def thinned(doc_id: str, run: str) -> str:
    """The run, without one letter where the hash of document and run says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc_id}:".encode()))
    if h % DROP_EACH:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
            if not text.is_valid:
                continue
            name = doc_id.as_py() or ""
            for run, n in Counter(_RUN.findall(text.as_py().lower().decode())).items():
                word = thinned(name, run)
                if len(word) >= LEAST_LETTERS:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield out()
                held.clear()
    yield out()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: maximal runs of letters of all texts, A-Z in lower case, some of them thinned, that are long and frequent.

    Null and empty texts have no words; a missing id hashes as an empty one. Counts are added up per task before
    they are shuffled.
    """
    let_workers_import(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    counted = given.mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- blocks


def _group_counts(word: str) -> Column:
    """How many letters of each group a word has."""
    others = ["".join(c for c in _LETTERS if ord(c) % GROUPS != g) for g in range(GROUPS)]
    return F.array(*(F.length(F.translate(word, o, "")) for o in others))


def _block(counts: Column) -> Column:
    return F.array_join(counts.cast("array<string>"), ".")


def _reached(counts: Column) -> Column:
    """Blocks one edit leads to from a block, each pair of blocks from one side only: ``(block, longer)``."""
    moved = lambda **by: F.transform(counts, lambda c, i: c + sum(F.when(i == int(g[1:]), F.lit(d)).otherwise(0) for g, d in by.items()))
    same = [_block(counts)] + [_block(moved(**{f"g{a}": 1, f"g{b}": -1})) for a in range(GROUPS) for b in range(a + 1, GROUPS)]
    longer = [_block(moved(**{f"g{a}": 1})) for a in range(GROUPS)]
    return F.array(*(F.struct(b.alias("block"), F.lit(False).alias("longer")) for b in same),
                   *(F.struct(b.alias("block"), F.lit(True).alias("longer")) for b in longer))


def tiles(words: DataFrame) -> DataFrame:
    """``(block, part, counts, words, ns)``: the words of a block in parts of bounded size, one row each."""
    keyed = words.withColumn("counts", _group_counts("word")).withColumn("block", _block(F.col("counts")))
    sizes = keyed.groupBy("block").agg(F.count("*").alias("rows"), F.max(F.length("word")).alias("letters"))
    most = F.greatest(F.least(F.lit(TILE_WORDS), F.floor(F.lit(TILE_LETTERS) / F.col("letters"))), F.lit(1))
    parts = sizes.select("block", F.ceil(F.col("rows") / most).cast("int").alias("parts"))
    dealt = keyed.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    packed = dealt.groupBy("block", "part").agg(F.first("counts").alias("counts"), F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))
    return packed.select("block", "part", "counts", F.col("w.word").alias("words"), F.col("w.n").alias("ns"))


# ---------------------------------------------------------------- pairs


def letter_matrix(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter codes (all letters lie below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    place = np.zeros(256, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    flat = place[letters] + np.arange(len(letters))[:, None] * len(alphabet)
    kind = np.float32 if letters.shape[1] <= 2_000 else np.float64  # products of counts stay exact
    return np.bincount(flat.ravel(), minlength=len(letters) * len(alphabet)).reshape(len(letters), -1).astype(kind)


def candidates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` whose letter counts lie as one edit would leave them: squared distance 2, or 1 where ``b`` is longer."""
    wanted = 2 if a.shape[1] == b.shape[1] else 1
    alphabet = np.union1d(np.unique(a), np.unique(b))
    x, y = letter_counts(a, alphabet), letter_counts(b, alphabet)
    one = lambda m: np.ones((len(m), 1), m.dtype)
    left = np.hstack([-2 * x, (x * x).sum(1, keepdims=True), one(x)])
    right = np.hstack([y, one(y), (y * y).sum(1, keepdims=True) - wanted])
    return np.nonzero(left @ right.T == 0)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one replaced letter, or by one inserted into ``a`` where ``b`` is longer."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(1) == 1
    head, tail = a == b[:, :size], a == b[:, 1:]
    led = np.where(head.all(1), size, head.argmin(1))  # letters up to the first difference
    last = np.where(tail.all(1), -1, size - 1 - tail[:, ::-1].argmin(1))  # and the last one seen from the end
    return last < led


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows one edit apart; each pair once where both sides are the ``same`` rows."""
    i, j = candidates(a, b)
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, COMPARED_LETTERS // b.shape[1])
    keep = [one_edit(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    kept = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[kept], j[kept]


def _best(of: np.ndarray, other: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row in ``of``: how many partners, and the one of largest count, the first of these in order."""
    order = np.lexsort((other, -ns[other], of))
    rows, first, near = np.unique(of[order], return_index=True, return_counts=True)
    return rows, near, other[order][first]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "near", "best_n", "best"]
    for batch in batches:
        for row in range(batch.num_rows):
            words, ns, other, other_ns, same = (c[row].as_py() for c in batch.columns)
            a, b, na, nb = letter_matrix(words), letter_matrix(other), np.array(ns), np.array(other_ns)
            i, j = near_pairs(a, b, same)
            for of, to, mine, theirs, n in ((i, j, words, other, nb), (j, i, other, words, na)):
                rows, near, best = _best(of, to, n)
                yield pa.record_batch(
                    [pa.array([mine[k] for k in rows], pa.string()), pa.array(near, pa.int64()),
                     pa.array(n[best], pa.int64()), pa.array([theirs[k] for k in best], pa.string())], names)


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``(word, n)`` that have a near one: how many, and the most frequent.

    Of equally frequent ones the smallest in code-point order. All words have the same least length, no count bounds
    the words of a block: a block of many words is many tiles, and every pair of tiles is a row of its own.
    """
    let_workers_import(words.sparkSession)
    packed = written(tiles(words), "tiles")
    here = packed.select(F.explode(_reached(F.col("counts"))).alias("to"), F.col("block").alias("home"),
                         F.col("part").alias("home_part"), F.col("words").alias("a"), F.col("ns").alias("na"))
    there = packed.select("block", "part", "words", "ns")
    met = here.select("to.block", "home", "home_part", "a", "na").join(there, "block")
    once = met.filter((F.col("home") != F.col("block")) | (F.col("home_part") <= F.col("part")))
    itself = (F.col("home") == F.col("block")) & (F.col("home_part") == F.col("part"))
    found = once.select("a", "na", "words", "ns", itself.alias("same")).mapInArrow(
        _compared, "word string, near long, best_n long, best string"
    )
    best = F.min(F.struct(-F.col("best_n"), F.col("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.col1")).alias("best_n"), F.col("b.best").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: the end of the chain of forms. A form is far more frequent, so chains are short."""
    state = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        next_ = state.select(F.col("word").alias("w"), F.col("root").alias("further"))
        joined = state.join(next_, F.col("root") == F.col("w"), "left")
        moved = written(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("w").isNotNull().alias("moved")), "forms")
        state = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return state


def with_forms(words: DataFrame) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for ``(word, n)``, distinct words of at least ``LEAST_LETTERS`` letters.

    ``form`` is the near word of largest count (ties: the smallest), if that is ``RATIO`` times the word's own or more,
    ``root`` the last form that forms lead to, the word itself where there is none. An empty table gives an empty one.
    """
    words = written(words.select("word", "n"), "words")
    near = words.join(neighbours(words), "word", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    formed = written(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "formed",
    )
    ends = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
