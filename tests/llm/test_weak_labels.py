import random
from collections import Counter

from snapfold.llm import weak_labels
from snapfold.llm.queries import op3_quality_classifier


def test_held_out_accuracy(spark):
    """The labels of the table are never read by the classifier, so all of them are held out."""
    sf = "/root/testdata/sf0.01"
    seen = op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r.kept for r in seen if r.quality == 1], [r.kept for r in seen if r.quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.05 * len(bad)


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(4)
    n = len(weak_labels.LABELLERS)
    right = [0.9, 0.8, 0.7] + [0.85] * (n - 3)
    patterns = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        # a defect is found in a share of the bad texts only, and never in good ones
        patterns["".join("0" if good or rng.random() > p else "-" for p in right)] += 1
    model = weak_labels.LabelModel(patterns)
    assert abs(model.prior[1] - 0.8) < 0.02
    for j, p in enumerate(right):
        assert abs(model.says[j][2, 0] - p) < 0.05
    assert model.good("0" * n) > 0.95 > 0.05 > model.good("-" * n)


def test_scorer_separates_words():
    rows = [weak_labels._features(b"alpha beta gamma") + (1.0,), weak_labels._features(b"### $$$ ***") + (0.0,)] * 20
    weights, bias = weak_labels.fit_scorer(rows)
    mean = lambda text: bias + sum(v * weights[b] for b, v in zip(*weak_labels._features(text), strict=True))
    assert mean(b"gamma alpha") > 0 > mean(b"$$$ ###")


def test_shapes():
    assert weak_labels.shape(b"Word&&&12") == b"Aa&&&0"
    assert weak_labels.shape("éÉa".encode()) == b"a"


def test_awkward_rows(spark, docs_of):
    good = "The reader of the text goes on. It is good. "
    pairs = [(1, good * 3), (1, good * 3), (2, None), (3, ""), (4, " \n"), (None, good * 2), (5, "&&& " * 80_000)]
    pairs += [(k, good + f"word{k} is in it.") for k in range(10, 60)] + [(k, "x### y$$$ z%%% " * 20) for k in range(60, 70)]
    docs = docs_of(pairs, extra=("votes", "quality", "kept"))
    kept = weak_labels.good_rows(docs)
    assert kept.columns == docs.columns
    ids = sorted(((r.doc_id) for r in kept.collect()), key=repr)
    assert ids == sorted([1, 1, None, *range(10, 60)], key=repr)
    scored = weak_labels.with_quality(docs, "verdict").collect()
    assert len(scored) == len(pairs) and all(0 <= r.verdict.score <= 1 for r in scored)
    assert weak_labels.good_rows(docs_of([])).count() == 0
