import random

import numpy as np
import pytest
import xxhash

from snapfold.llm import simhash
from snapfold.llm.queries import op10_simhash
from snapfold.llm.rows import spread_lookup


def plain_print(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    root = {p: p for p in set(prints)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(root)
    for a in known:
        for b in known:
            if a < b and (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in known}


def brute_force(pairs, radius=4):
    prints = [plain_print(t) for _, t in pairs]
    roots = plain_components(prints, radius)
    least = {}
    for (i, _), p in zip(pairs, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(((i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(pairs, prints, strict=True)), key=repr)


def found(spark, docs):
    df = simhash.near_duplicates(docs, shingle=4, radius=4)
    return sorted(((r[0], r[1], r[2]) for r in df.select("doc_id", simhash.hex_print("fp"), "component").collect()), key=repr)


def test_fingerprint_against_plain_form():
    for text in ("", "  \n", "one", "A b C", "Ä é A\tb\vc d e f", "x " * 300, "straße x a b c d"):
        assert simhash.simhash64(text.encode(), 4) == plain_print(text)
    assert simhash.simhash64(None, 4) == 0


def test_documents_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = op10_simhash(spark, data).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute_force(pairs)


def test_awkward_rows(spark, docs_of):
    base = " ".join(f"w{k}" for k in range(400))
    pairs = [
        (5, base), (3, base), (3, base), (None, base), (9, base.replace("w7 ", "v7 ")), (8, None), (7, ""), (6, " \n"),
        (4, "Long " * 30_000), (2, "one"), (None, "alone here"), (None, "alone here"),
    ]
    docs = docs_of(pairs, extra=("fp", "component", "tile"))
    assert found(spark, docs) == brute_force(pairs)
    kept = simhash.keep_one(docs, shingle=4, radius=4)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    expected = {c for _, _, c in brute_force(pairs) if c is not None}
    assert ids == sorted([*expected, None], key=repr)


def test_empty_table(spark, docs_of):
    assert found(spark, docs_of([])) == []
    assert simhash.keep_one(docs_of([]), shingle=4, radius=4).count() == 0


@pytest.mark.parametrize("tile_rows", [1, 7, 50, 10_000])
def test_tiles_miss_no_link(spark, monkeypatch, tile_rows):
    rng = random.Random(tile_rows)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                p ^= 1 << b
            prints.add(p)
    monkeypatch.setattr(simhash, "TILE_ROWS", (tile_rows, tile_rows))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    roots = {r.v & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.links(table, 4)).collect()}
    expected = plain_components(prints)
    groups = lambda of: sorted(sorted(q for q in prints if of.get(q, q) == r) for r in {of.get(p, p) for p in prints})
    assert groups(roots) == groups(expected)


def test_forest_is_no_larger_than_its_nodes():
    near = np.array([0] + [1 << b for b in range(64)], dtype=np.uint64)
    forest = simhash.tile_forest(near, np.zeros(65, dtype=np.int8), 4)
    assert len(forest) == 64


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    assert {r.v: r.root for r in simhash.components(edges).collect()} == {
        **{k: 0 for k in range(201)}, 500: 500, 501: 500,
    }


def test_hot_keys_are_spread_without_loss(spark, monkeypatch):
    monkeypatch.setattr("snapfold.llm.rows.ROWS_PER_TASK", 10)
    monkeypatch.setattr("snapfold.llm.rows.MAX_HOT_KEYS", 1_000)
    rows = spark.createDataFrame([(k, 1 if k % 3 else 2 + k) for k in range(300)], "doc_id long, fp long")
    values = rows.groupBy("fp").count().withColumnRenamed("count", "n").selectExpr("fp", "n", "fp * 10 as v")
    joined = spread_lookup(rows, values, "fp", "n")
    assert sorted((r.doc_id, r.v) for r in joined.collect()) == sorted((r.doc_id, r.fp * 10) for r in rows.collect())


def test_one_id_on_two_texts_keeps_a_row_of_each_component(spark, docs_of):
    a, b, c = (" ".join(f"{x}{k}" for k in range(400)) for x in "abc")
    pairs = [(1, a), (1, b), (2, a), (3, b), (1, b), (2, c), (4, c)]
    rows = simhash.keep_one(docs_of(pairs), shingle=4, radius=4).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, a), (1, b), (2, c)]
