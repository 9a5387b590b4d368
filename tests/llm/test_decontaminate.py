import hashlib
import re

from snapfold.llm import decontaminate
from snapfold.llm.queries import op2_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(text, items, size=10):
    doc, hit, found = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if w else ():
            for at in range(len(doc) - n + 1):
                if doc[at : at + n] == w[k : k + n]:
                    hit |= set(range(at, at + n))
                    found.add(item)
    return len(doc), len(hit), sorted(found)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_documents_against_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = op2_decontamination(spark, data).collect()
    assert len(rows) == len(docs)
    assert any(r.contaminated for r in rows)
    for r in rows:
        n, hit, found = brute_force(docs[r.doc_id], items)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), digest, hit > 0)


def test_spans_lie_in_the_original(spark, docs_of):
    items = [(1, "Was ist das für ein Ding, das so läuft?"), (2, "short"), (12, "SHORT!"), (3, None), (4, ""), (None, "nothing")]
    text = "Ä: WAS ist das--für ein DING, das so   läuft; and Short, nothing shorter."
    docs = docs_of([(1, text), (2, None), (3, ""), (4, "!?"), (1, text), (5, "filler " * 60_000 + "short")], extra=("found", "items"))
    found = decontaminate.with_passages(docs, bench(spark, items), "hits", window=9)
    for r in found.collect():
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == brute_force(r.text, [i for i in items if i[0] is not None], 9)
        if r.doc_id == 1:
            spans = [r.text[s.start : s.end] for s in r.hits.spans]
            assert spans == ["WAS ist das--für ein DING, das so   läuft", "Short"]
    assert decontaminate.with_passages(docs, bench(spark, items), "found", window=9).columns == docs.columns
    clean = decontaminate.clean_of(docs, bench(spark, items), window=9)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]


def test_windows_that_overlap_and_nest(spark, docs_of):
    items = [(1, "a b c d"), (2, "c d e f"), (3, "d"), (4, "b c")]
    texts = ["a b c d e f", "x d x", "a b c a b c d", "b c b c b c d e", "abcd", "a b c"]
    docs = docs_of(list(enumerate(texts)))
    for r in decontaminate.with_passages(docs, bench(spark, items), "hits", window=3).collect():
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == brute_force(r.text, items, 3)


def test_blocks_of_the_benchmark_agree(spark, docs_of, monkeypatch):
    items = [(k, f"w{k} w{k + 1} w{k + 2} w{k + 3}") for k in range(30)]
    docs = docs_of([(1, " ".join(f"W{k}," for k in range(0, 40))), (2, "none"), (3, None)])
    whole = decontaminate.with_passages(docs, bench(spark, items), "hits", window=3).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    parts = decontaminate.with_passages(docs, bench(spark, items), "hits", window=3).collect()
    for a, b in zip(whole, parts, strict=True):
        assert (a.hits.n_words, a.hits.n_hit, a.hits["items"]) == (b.hits.n_words, b.hits.n_hit, b.hits["items"])


def test_empty_tables(spark, docs_of):
    assert decontaminate.clean_of(docs_of([]), bench(spark, [(1, "a")])).count() == 0
    assert decontaminate.clean_of(docs_of([(1, "a")]), bench(spark, [])).count() == 1
