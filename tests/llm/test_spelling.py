import random
import zlib
from collections import Counter

import numpy as np
import pytest

from snapfold.llm import spelling
from snapfold.llm.queries import op13_spelling_variants


def plain_words(docs):
    letters = set(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
    found = Counter()
    for doc_id, text in docs:
        runs, run = [], ""
        for c in (text or "") + " ":
            if c in letters:
                run += c.lower() if c < "\x80" else c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(words):
    """By the words left when one letter is taken out: near words share one of them."""
    holders = {}
    for w in words:
        for key in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + "?" + w[k + 1 :] for k in range(len(w))}:
            holders.setdefault(key, []).append(w)
    met = {w: set() for w in words}
    for group in holders.values():
        for a in group:
            met[a].update(group)
    best = {}
    for w in words:
        partners = [v for v in met[w] if v != w and near(v, w)]
        top = min(partners, key=lambda v: (-words[v], v), default=None)
        best[w] = (len(partners), top if top is not None and words[top] >= 10 * words[w] else None)
    rows = []
    for w, n in words.items():
        root = w
        while best[root][1] is not None:
            root = best[root][1]
        form = best[w][1]
        rows.append((w, n, best[w][0], form, words[form] if form else None, root))
    return sorted(rows)


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def invented(rng, n):
    words = Counter()
    for _ in range(n):
        w = "".join(rng.choices(["ab", "be", "an", "é", "ÿ", "to", "th", "x"], k=rng.randint(4, 7)))
        for v in (w, w[1:], w[:3] + "q" + w[3:], w[:2] + "é" + w[3:], w[::-1]):
            if len(v) >= 7:
                words[v] += rng.choice([2, 3, 20, 300, 4_000])
    return dict(words)


@pytest.mark.parametrize("tile", [1, 3, 2_048])
def test_forms_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE_WORDS", tile)
    words = invented(random.Random(tile), 60 if tile == 1 else 300)
    words |= {"a" * 6_000: 2, "a" * 5_999: 50, "a" * 5_999 + "b": 600}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.with_forms(table)) == plain_forms(words)


def test_documents_against_brute_force(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows = op13_spelling_variants(spark, data)
    assert {"word", "form", "root", "n", "n_near", "form_n"} <= set(rows.columns)
    assert found(rows) == plain_forms(plain_words(docs))


def test_awkward_texts(spark, docs_of):
    pairs = [(k, "Anderson andersom ANDERSON ÀÉÎÕÜÿ×÷ß") for k in range(40)]
    pairs += [(None, "anderson andersom nullidword nullidword"), (50, None), (51, ""), (52, "abc" * 40_000), (52, "abc" * 40_000)]
    pairs += [(53, "one1two2 straßenname straœenname Ābcdefgh"), (53, "one1two2 straßenname bcdefgh"), (7, "Anderson")]
    words = plain_words(pairs)
    assert "straßenname" in words and "anderson" in words and "bcdefgh" in words
    table = docs_of(pairs, extra=("word", "n", "form", "block"))
    assert found(spelling.with_forms(spelling.word_counts(table))) == plain_forms(words)
    assert spelling.with_forms(spelling.word_counts(docs_of([]))).collect() == []


def test_chains_of_forms_end_at_the_root(spark):
    names = ["aaaaaaa" + "b" * k for k in range(7)]
    words = {w: 2 * 10**k for k, w in enumerate(names)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r.root for r in spelling.with_forms(table).collect()} == {names[-1]}


def test_counts_of_very_long_words_stay_exact():
    a, b = spelling.letter_matrix(["a" * 9_000 + "b" * 9_000]), spelling.letter_matrix(["a" * 9_001 + "b" * 8_999])
    assert [len(x) for x in spelling.near_pairs(a, b, False)] == [1, 1]
    assert len(spelling.near_pairs(a, a, True)[0]) == 0
    rng = np.random.default_rng(1)
    m = rng.integers(97, 99, (200, 8)).astype(np.uint8)
    m = np.unique(m, axis=0)
    pairs = set(zip(*(x.tolist() for x in spelling.near_pairs(m, m, True)), strict=True))
    assert pairs == {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if (m[i] != m[j]).sum() == 1}
