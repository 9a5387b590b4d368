import math
import random
from collections import Counter

import numpy as np
import pytest

from snapfold.llm import search
from snapfold.llm.queries import op12_lexical_search


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def plain_ranks(docs, queries, top=50):
    terms = [(i, Counter(words(t))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    n_docs, total = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    wanted = {}
    for i, text in queries:
        if i is not None:
            wanted.setdefault(i, set()).update(words(text))
    rows = []
    for item, query in wanted.items():
        scored = []
        for i, c, n in terms:
            m = 50 + (50 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in query
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda r: r[:3])[:top], 1)]
    return sorted(rows, key=repr)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def tables(spark, docs, queries, extra=()):
    more = "".join(f", {c} string" for c in extra)
    x = ("x",) * len(extra)
    return (
        spark.createDataFrame([(i, t, *x) for i, t in docs], "doc_id long, text string" + more),
        spark.createDataFrame([(i, t, *x) for i, t in queries], "item_id long, text string" + more),
    )


@pytest.mark.parametrize(("first", "growth", "block"), [(1, 1, 10**6), (30, 2, 200), (20_000, 8, 4_000_000)])
def test_random_texts_against_brute_force(spark, monkeypatch, first, growth, block):
    monkeypatch.setattr(search, "FIRST_WAVE", first)
    monkeypatch.setattr(search, "WAVE_GROWTH", growth)
    monkeypatch.setattr(search, "BLOCK_CHARS", block)
    rng = random.Random(first)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=n))
    docs = [(k, text(rng.choice([1, 5, 40, 300]))) for k in range(150)]
    docs += [(1_000 + k, docs[7][1]) for k in range(20)]
    queries = [(k, text(rng.randint(1, 12))) for k in range(12 if block > 1_000 else 6)]
    queries += [(50, docs[7][1][:80]), (51, "absent words only")]
    assert found(search.with_ranks(*tables(spark, docs, queries), top=7)) == plain_ranks(docs, queries, 7)


def test_documents_against_brute_force(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    queries = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(op12_lexical_search(spark, data)) == plain_ranks(docs, queries)


def test_awkward_rows(spark):
    docs = [(None, "alpha Beta"), (None, "alpha"), (3, None), (4, ""), (5, "?! \n"), (6, "alpha beta beta"), (6, "alpha beta beta"),
            (2, "alpha beta beta"), (9, "ÄLPHA älpha Ä1 é"), (10, "beta " * 60_000), (11, "gamma")]
    queries = [(1, "Alpha BETA?"), (1, "gamma"), (2, "Äx älpha"), (3, None), (4, "!"), (None, "alpha"), (7, "alpha alpha"), (7, "alpha")]
    given = tables(spark, docs, queries, extra=("score", "rank", "item", "n"))
    assert found(search.with_ranks(*given)) == plain_ranks(docs, queries)


def test_empty_tables(spark):
    docs, queries = [(1, "alpha")], [(1, "alpha")]
    assert found(search.with_ranks(*tables(spark, [], queries))) == []
    assert found(search.with_ranks(*tables(spark, docs, []))) == []
    assert found(search.with_ranks(*tables(spark, [(1, " ")], queries))) == []


def bucket_of(rng, n, n_terms):
    sizes = rng.integers(1, 12, n)
    terms = np.concatenate([rng.choice(n_terms, s, replace=False) for s in sizes]).astype(np.int32)
    impacts = rng.integers(1, 1_000_000, len(terms))
    return sizes, terms, impacts


def test_bounds_never_drop_a_document():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n_terms = 30
        weights = rng.integers(0, 13_000, n_terms)
        sizes, terms, impacts = bucket_of(rng, 80, n_terms)
        owner = np.repeat(np.arange(80), sizes)
        lengths = np.sqrt(np.bincount(owner, weights=weights[terms] * impacts.astype(float) ** 2, minlength=80))
        bucket = search.Bucket(np.arange(80), lengths, sizes, terms, impacts)
        query = np.sort(rng.choice(n_terms, 8, replace=False)).astype(np.int32)
        full = np.bincount(owner, weights=np.where(np.isin(terms, query), weights[terms] * impacts, 0), minlength=80).astype(int)
        for threshold in (0, int(np.median(full)), int(full.max()), int(full.max()) + 1):
            rows, scores, _ = bucket.search(query, weights[query], threshold)
            assert set(np.flatnonzero(full >= max(threshold, 1))) <= set(rows.tolist())
            assert (scores == full[rows]).all()


def test_postings_are_passed_over(spark, data, monkeypatch):
    monkeypatch.setattr(search, "FIRST_WAVE", 20)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = search.items_of(spark.read.parquet(f"{data}/benchmark.parquet"), 0, 1)
    _, share = search._search_block(docs, items, "doc_id", "text", 3)
    assert 0 < share < 1
