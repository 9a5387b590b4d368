"""Benchmark passages in texts, found by one Aho-Corasick automaton over the normalised benchmark.

A text is normalised to its words (ASCII letters in lower case, digits, everything beyond ASCII), and each word to
its number among the benchmark's. The patterns are the windows of ``window`` numbers of every item. One scan of a text's
numbers finds all windows; the places of the words lead back to the original.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.rows import free_name, text_function

WINDOW = 10
#: Characters of benchmark text in one automaton; a larger benchmark is scanned for in several.
BLOCK_CHARS = 16_000_000
_WORD = regex.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
#: Bytes of a text -> lower case, or a space where no word goes on.
_PLAIN = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256)
)
_FOUND = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<long>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def windows(words: list[int], size: int) -> set[tuple[int, ...]]:
    """All runs of ``size`` words, or all words where there are fewer; none of no words."""
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


class PassageFinder:
    """The automaton reads numbers of words, not characters: a tenth of the states, and matches are whole words."""

    def __init__(self, items: list[tuple[int, bytes]], size: int):
        #: numbers of the benchmark's words from 1 on; all other words are 0, which no window has
        self.numbers: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], int | set] = {}
        for item, text in items:
            numbered = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_words(text)]
            for window in windows(numbered, size):
                held = holders.setdefault(window, item)
                if isinstance(held, set):
                    held.add(item)
                elif held != item:
                    holders[window] = {held, item}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        while holders:
            window, held = holders.popitem()
            self.automaton.add_word(window, (len(window), held))
        if self.numbers:
            self.automaton.make_automaton()

    def find(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[int]]:
        """Number of words, the word ranges inside windows (merged, in order), the items whose windows occur."""
        words = normal_words(text or b"")
        if not words or not self.numbers:
            return len(words), [], []
        number, ranges, items = self.numbers.get, [], set()
        for last, (n, held) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            items.update(held if isinstance(held, set) else (held,))
            ranges.append((last + 1 - n, last + 1))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        return len(words), merged, sorted(items)


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as code-point spans of the text as it was."""
    places = [m.span() for m in _WORD.finditer(text)] if ranges else []
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]


@lru_cache(maxsize=4)
def _finder(items: tuple, size: int) -> PassageFinder:
    return PassageFinder(list(items), size)


def _search(items, size: int):
    def make():
        finder = _finder(items.value, size)

        def run(texts):
            out = []
            for text in texts:
                n, ranges, ids = finder.find(text)
                spans = original_spans(text.decode(), ranges) if ranges else []
                out.append({"n_words": n, "n_hit": sum(b - a for a, b in ranges), "spans": spans, "items": ids})
            return pa.array(out, _TYPE)

        return run

    return text_function(make, _FOUND)


_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.int64())),
    ]
)


def with_passages(docs: DataFrame, benchmark: DataFrame, out: str, text: str = "text", *, window: int = WINDOW) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit (words inside an occurring window), spans of the original text in
    code points (end exclusive, merged) and items (ids with an occurring window, ascending).

    ``benchmark`` has item_id and text; rows without an id or without words are no items, rows of one id are one item.
    The benchmark is sent to the executors in blocks of about ``BLOCK_CHARS`` characters, one automaton each; the
    results of several blocks are merged word by word by a second scan for the spans found. A column ``out`` that
    ``docs`` has is replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter(
        "item_id is not null and text is not null"
    )
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-chars // BLOCK_CHARS) or 1
    result = docs
    blocks = []
    for k in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).collect()
        rows = spark.sparkContext.broadcast(tuple(sorted((r.item_id, r.text.encode()) for r in part)))
        blocks.append(free_name(result, "found"))
        result = result.withColumn(blocks[-1], _search(rows, window)(text))
    if n_blocks == 1:
        return result.withColumn(out, F.col(blocks[0])).drop(blocks[0])
    both = {c: F.flatten(F.array(*(F.col(f"{b}.{c}") for b in blocks))) for c in ("spans", "items")}
    merge = F.arrow_udf(_merge_spans, "n_hit long, spans array<struct<start:int,end:int>>")
    joined = merge(F.col(text).cast("string"), both["spans"])
    return result.withColumn(
        out,
        F.struct(
            F.col(f"{blocks[0]}.n_words").alias("n_words"),
            joined["n_hit"].alias("n_hit"),
            joined["spans"].alias("spans"),
            F.array_sort(F.array_distinct(both["items"])).alias("items"),
        ),
    ).drop(*blocks)


def _merge_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        merged: list[list[int]] = []
        for a, b in sorted((s["start"], s["end"]) for s in found):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        n = sum(len(_WORD.findall(text, a, b)) for a, b in merged)
        out.append({"n_hit": n, "spans": [{"start": a, "end": b} for a, b in merged]})
    kind = pa.struct([("n_hit", pa.int64()), _TYPE.field("spans")])
    return pa.array(out, kind)


def clean_of(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` in which no window of the benchmark occurs; null and wordless texts stay."""
    found = free_name(docs, "passages")
    return with_passages(docs, benchmark, found, text, window=window).filter(F.col(found)["n_hit"] == 0).select(docs.columns)
