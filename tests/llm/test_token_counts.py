import random

import pytest
from tokenizers import Tokenizer, models

from snapfold.llm import token_counts
from snapfold.llm.queries import UNIGRAM_FILE, op5_token_counts

SPACE = token_counts.SPACE


@pytest.fixture(scope="module")
def vocabulary():
    with open(UNIGRAM_FILE, "rb") as file:
        return token_counts.vocabulary_of(file.read())


@pytest.fixture(scope="module")
def library(vocabulary):
    """A unigram model of the same pieces and scores; its byte pieces are far below all others."""
    bytes_ = [(f"<0x{b:02X}>", -2e9) for b in range(256)]
    return Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.pieces, *bytes_], unk_id=0, byte_fallback=True))


def expected(library, text):
    return len(library.encode(SPACE + text.replace(" ", SPACE), add_special_tokens=False).ids) if text else 0


def test_counts_are_those_of_the_library(vocabulary, library):
    rng = random.Random(2)
    kinds = ["aaab ", "eiou thsx", "  \n\t", "'srtl", "0123", "éüßñ中文漢字", "🙂👩‍👧﻿𐍈", ".,!?&$#*"]
    counter = token_counts.PieceCounter(vocabulary)
    assert counter.chunked
    for _ in range(3_000):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 20)))
        assert counter.count(text)[0] == expected(library, text)


def best_by_search(vocabulary, text):
    """All segmentations, the tie rule as said: of equal scores the one whose last piece is longest, and so on back."""
    scores, low = dict(vocabulary.pieces), min(s for _, s in vocabulary.pieces) - token_counts.UNKNOWN_PENALTY
    best = [(0.0, ())]
    for end in range(1, len(text) + 1):
        options = [(best[a][0] + scores[text[a:end]], best[a][1] + (text[a:end],)) for a in range(end) if text[a:end] in scores]
        if text[end - 1] not in scores:
            options.append((best[end - 1][0] + low, best[end - 1][1] + (None,)))
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    pieces = best[-1][1]
    return sum(not (p is None and k and pieces[k - 1] is None) for k, p in enumerate(pieces)), best[-1][0]


def test_ties_and_unknown_runs():
    rng = random.Random(9)
    for _ in range(300):
        pieces = {"".join(rng.choice("abc" + SPACE) for _ in range(rng.randint(1, 4))): float(rng.randint(-4, -1)) for _ in range(8)}
        vocabulary = token_counts.UnigramVocabulary(tuple(pieces.items()), False)
        counter = token_counts.PieceCounter(vocabulary)
        for _ in range(20):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9)))
            if counter.chunked:
                assert counter.count(text)[1] == best_by_search(vocabulary, SPACE + text.replace(" ", SPACE))[1]
            assert counter.best(text) == best_by_search(vocabulary, text)


def test_query_and_awkward_rows(spark, data, docs_of, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op5_token_counts(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == expected(library, texts[r.doc_id])
    pairs = [(1, None), (2, ""), (3, "a  b"), (3, "a  b"), (None, "é🙂"), (4, "long text " * 20_000)]
    docs = docs_of(pairs, extra=("counted", "n_tokens"))
    for r in token_counts.with_counts(docs, UNIGRAM_FILE, "pieces").collect():
        assert r.pieces.n_tokens == expected(library, r.text)
    assert token_counts.with_counts(docs_of([]), UNIGRAM_FILE, "pieces").count() == 0
