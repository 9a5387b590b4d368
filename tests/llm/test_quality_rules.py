import re

from snapfold.llm import quality_rules
from snapfold.llm.queries import op9_quality_rules


def brute_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)}
    n, chars = len(words), sum(map(len, words))
    failed = n < 50 or 100 * len(covered) > 50 * n
    dups = sum(1 for k, x in enumerate(lines) if x in lines[:k])
    return n, chars, sum(c in "#*$%&|<>" for c in text), dups, len(covered), failed


TEXTS = [None, "", " \n ", "a b c", "a b c a b c a b", "x " * 80, "é à b\x1cc # *|\n# *|\n\n# *| ", "w " + " ".join(map(str, range(70)))]


def test_measures_against_brute_force(spark, data, docs_of):
    rows = spark.read.parquet(f"{data}/documents.parquet").filter("n_chars < 6000").collect()
    docs = docs_of([*enumerate(TEXTS), *((r.doc_id, r.text) for r in rows)], extra=("rules", "kept"))
    for r in quality_rules.with_rules(docs, "verdict").collect():
        v = r.verdict
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == brute_force(r.text)
        assert not (v.kept and v.base_failed)


def test_order_of_rules_changes_no_verdict():
    pages = [t.encode() if t else t for t in TEXTS] + [b"| ## " * 90, b"THE LOUD ONE " + b" ".join(b"W%d" % k for k in range(90))]
    rules = quality_rules.BASE + quality_rules.RULES
    for t in pages:
        one, other = (quality_rules.first_failure(quality_rules.Page(t), r) for r in (rules, rules[::-1]))
        assert (one is None) == (other is None)


def test_rules_by_rejection_per_cost():
    cost = {"too_few_words": (1e-6, 0.1), "repeated_words": (1e-4, 0.5), "symbols": (1e-6, 0.2), "mostly_upper": (1e-6, 0.0)}
    names = [r.name for r in quality_rules.order_rules(cost)]
    assert names[:4] == ["symbols", "too_few_words", "repeated_words", "mostly_upper"]


def test_later_rules_do_not_run():
    ran = []
    first = quality_rules.Rule("first", lambda p: True)
    second = quality_rules.Rule("second", lambda p: ran.append(1) or True)
    assert quality_rules.first_failure(quality_rules.Page(b"x"), (first, second)) == "first" and not ran


def test_good_labelled_texts_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = op9_quality_rules(spark, sf).join(labels, "doc_id").filter("not base_failed")
    assert seen.filter("quality = 1 and not kept").count() == 0
    assert seen.filter("quality = 0 and kept").count() <= 0.05 * labels.filter("quality = 0").count()


def test_empty_and_repeated_rows(spark, docs_of):
    assert quality_rules.kept_rows(docs_of([])).count() == 0
    good = " ".join(f"word{k}" for k in range(60))
    docs = docs_of([(1, good), (1, good), (None, good), (2, "few")], extra=("rules",))
    assert quality_rules.kept_rows(docs).columns == docs.columns
    assert sorted(r.doc_id or 0 for r in quality_rules.kept_rows(docs).collect()) == [0, 1, 1]
