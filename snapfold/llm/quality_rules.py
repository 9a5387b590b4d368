"""Quality rules as a short-circuit cascade, ordered by what a sample says about their cost and selectivity."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.rows import free_name, let_workers_import, text_function

#: Rows of the sample that orders the rules, about; it decides no verdict.
SAMPLE_ROWS = 2_000
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SPACES = b" \t\n\v\f\r"


class Page:
    """A text and the measures of it that have been asked for; each is taken once."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    def __getattr__(self, name: str):
        value = _MEASURES[name](self)
        setattr(self, name, value)
        return value


def _repeated(page: Page) -> int:
    words = page.words
    triples = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(triples)
    if len(counts) == len(triples):
        return 0
    covered, reach = 0, 0
    for k, triple in enumerate(triples):
        if counts[triple] > 1:
            covered += k + 3 - max(k, reach)
            reach = k + 3
    return covered


def _duplicate_lines(page: Page) -> int:
    lines = [x for x in page.text.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


_MEASURES: dict[str, Callable[[Page], int]] = {
    "words": lambda p: p.text.split(),
    "n_words": lambda p: len(p.words),
    "word_chars": lambda p: sum(map(len, p.words)) - len(p.text) + len(p.text.decode("utf-8", "replace")),
    "n_symbols": lambda p: len(p.text) - len(p.text.translate(None, _SYMBOLS)),
    "n_dup_lines": _duplicate_lines,
    "n_lines": lambda p: sum(1 for x in p.text.split(b"\n") if x.strip(_SPACES)),
    "n_repeat_words": _repeated,
    "n_upper": lambda p: len(p.text) - len(p.text.translate(None, _UPPER)),
    "n_lower": lambda p: len(p.text) - len(p.text.translate(None, _LOWER)),
    "n_bullets": lambda p: sum(1 for x in p.words if not x.strip(_SYMBOLS + b"-=_.!")),
}


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Page], bool]


#: The base rules and their limits.
BASE = (
    Rule("too_few_words", lambda p: p.n_words < 50),
    Rule("repeated_words", lambda p: 100 * p.n_repeat_words > 50 * p.n_words),
)
#: What the cascade adds. All are ratios, so that long texts are not judged by their length.
RULES = (
    Rule("symbols", lambda p: 4 * p.n_symbols > p.n_words),
    Rule("duplicate_lines", lambda p: 2 * p.n_dup_lines > p.n_lines),
    Rule("mostly_upper", lambda p: p.n_upper > p.n_lower),
    Rule("bare_marks", lambda p: 4 * p.n_bullets > p.n_words),
    Rule("word_length", lambda p: not 2 * p.n_words <= p.word_chars <= 25 * p.n_words),
)


def measured_cost(rows: DataFrame, rules=BASE + RULES, text: str = "text") -> dict[str, tuple[float, float]]:
    """Seconds a row and share of rows rejected, per rule, over ``rows``. A rule is timed with its own measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, failed, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for t in batch.column(0).cast(pa.large_binary()).to_pylist():
                n += 1
                for k, rule in enumerate(rules):
                    page, began = Page(t), time.perf_counter()
                    failed[k] += rule.fails(page)
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"k": list(range(len(rules))), "s": spent, "failed": failed, "n": [n] * len(rules)})

    let_workers_import(rows.sparkSession)
    seen = rows.select(F.col(text).cast("string")).mapInArrow(run, "k long, s double, failed long, n long")
    sums = seen.groupBy("k").agg(F.sum("s").alias("s"), F.sum("failed").alias("failed"), F.sum("n").alias("n")).collect()
    return {rules[r.k].name: (r.s / max(r.n, 1), r.failed / max(r.n, 1)) for r in sums}


def order_rules(cost: dict[str, tuple[float, float]], rules=BASE + RULES) -> tuple[Rule, ...]:
    """The rules by rejection per cost, the best first; those that the sample does not know come last, as given."""

    def gain(rule: Rule) -> float:
        seconds, share = cost.get(rule.name, (1.0, -1.0))
        return share / max(seconds, 1e-9)

    return tuple(sorted(rules, key=gain, reverse=True))


def sampled(docs: DataFrame, key: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of ``docs``, chosen by a hash of ``key``."""
    share = rows / max(docs.count(), 1)
    return docs.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def first_failure(page: Page, rules) -> str | None:
    """The first rule that rejects the text, if any; rules after it do not run."""
    return next((rule.name for rule in rules if rule.fails(page)), None)


_TYPE = pa.struct(
    [
        *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("failed", pa.string()),
    ]
)
_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, failed string"
)


def with_rules(docs: DataFrame, out: str, text: str = "text", *, key: str = "doc_id", measures: bool = True) -> DataFrame:
    """``docs`` with a struct ``out``: the base measures, base_failed, kept, and the rule that came first to reject.

    Whether a text is kept does not depend on the order of the rules, only ``failed`` and the time do. Null and empty
    texts have no words and fail. With ``measures=False`` the measures that no rule needed are null.
    """
    rules = order_rules(measured_cost(sampled(docs, key), text=text))
    base = {rule.name for rule in BASE}

    def verdict(t: bytes | None) -> dict:
        page = Page(t)
        failed = first_failure(page, rules)
        row = {"kept": failed is None, "failed": failed}
        wanted = [f.name for f in _TYPE][:5]
        if measures:
            return row | {c: getattr(page, c) for c in wanted} | {"base_failed": any(r.fails(page) for r in BASE)}
        return row | {c: vars(page).get(c) for c in wanted} | {"base_failed": failed in base}

    def make():
        return lambda texts: pa.array([verdict(t) for t in texts], _TYPE)

    return docs.withColumn(out, text_function(make, _DDL)(text))


def kept_rows(docs: DataFrame, text: str = "text", *, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    name = free_name(docs, "rules")
    return with_rules(docs, name, text, key=key, measures=False).filter(F.col(name)["kept"]).select(docs.columns)
