import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from snapfold.llm import secrets
from snapfold.llm.queries import BPE_FILE

SF = "/root/testdata/sf0.01"


def test_pipeline_against_brute_force(spark):
    """Each stage again, over what the one before it has kept, in plain Python."""
    from llm.test_decontaminate import brute_force as windows
    from llm.test_decontaminate import words
    from llm.test_simhash import brute_force as components

    def has_passage(text):
        doc = words(text)
        return any(tuple(doc[k : k + len(w)]) == w for k, x in enumerate(doc) for w in starts.get(x, ()))

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in corpus_pipeline.good_texts(spark, documents, SF).collect()}
    assert sum(labels.get(i) == 1 for i in texts if i not in good) <= 0.01 * sum(labels.get(i) == 1 for i in texts)
    kept = {i for i, _, c in components([(i, texts[i]) for i in sorted(good)]) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    starts = {}
    for w in {tuple(ws[k : k + 10]) for _, t in items for ws in [words(t)] for k in range(max(1, len(ws) - 9)) if ws}:
        starts.setdefault(w[0], []).append(w)
    clean = {i for i in kept if not has_passage(texts[i])}
    assert 0 < len(clean) < len(kept) < len(good) < len(texts)
    library = Tokenizer.from_file(BPE_FILE)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == clean and len(rows) == len(clean)
    ratio = secrets.train(documents.filter(documents.doc_id.isin(*clean)))
    for r in rows:
        text = texts[r.doc_id]
        for a, _, b in reversed(secrets.all_spans(text.encode(), ratio)):
            text = text[:a] + "\0" * (b - a) + text[b:]
        while "\0\0" in text:
            text = text.replace("\0\0", "\0")
        text = text.replace("\0", "[SECRET]")
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark, docs_of):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    good = "The first of the texts is good. It goes on for some time and it is read. "
    pairs = [(k, f"{good} Number {k} of w{k} v{k * 7} is u{k * k}.") for k in range(30)]
    pairs += [(3, pairs[3][1]), (40, pairs[4][1]), (41, good + bench), (42, None), (43, ""), (44, "### " * 500)]
    docs = docs_of(pairs, extra=("votes", "fp", "ids", "decoded", "passages", "masked"))
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, out, SF).collect())
    assert len(ids) == len(set(ids)) and set(ids) <= set(range(30))
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "BPE encoding and decoding",
    ]
