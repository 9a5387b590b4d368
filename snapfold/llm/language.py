"""Language of pages by Bayesian fusion of text, declared markup language, address suffix and host.

Each page has evidence of four kinds. The text's is a likelihood under letter-triple models of the languages, trained
on labelled documents. The declared language's is how often pages of a language declare it. Suffix and host act as a
prior: the languages of the pages of the same host, smoothed towards those of its domain, of its suffix and of all
pages, each level a grouped sum of what the text says, without the page itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.llm.rows import free_name, let_workers_import, spread_lookup, text_function, written

#: Buckets of the letter triples.
BUCKETS = 1 << 15
#: Added to every count of a triple.
SMOOTHING = 0.1
#: Triples overlap, so three of them count as one independent observation.
TEMPER = 1 / 3
#: Pages that each level of the host prior is worth to the level below.
LEVEL_WEIGHT = 2.0
#: Added to each declared value's count for a language.
DECLARED_SMOOTHING = 0.5
#: Languages, at most; a label beyond that is an error in the data.
MAX_LANGUAGES = 200

#: Elements whose content is not text of the page.
_UNSEEN = (b"script", b"style", b"nav", b"header", b"footer", b"aside", b"template", b"title")
_OPENS = re.compile(rb"<(?:(!--)|(" + b"|".join(_UNSEEN) + rb")\b)?", re.IGNORECASE)
_CLOSES = {b"!--": re.compile(rb"-->"), **{name: re.compile(rb"</" + name + rb"\s*>", re.IGNORECASE) for name in _UNSEEN}}
_HTML = re.compile(rb"<html\b", re.IGNORECASE)
_LANG = re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.IGNORECASE)
_ENTITY = re.compile(rb"&[A-Za-z0-9#]+;")
#: ASCII letters in lower case; bytes beyond ASCII as they are; all else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def triples(text: bytes) -> np.ndarray:
    """Buckets of the text's runs of three letters, single spaces between words."""
    plain = b" ".join([b"", *text.translate(_LETTERS).split(), b""])
    if len(plain) < 3:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(plain, dtype=np.uint8).astype(np.uint32)
    mixed = (b[:-2] * np.uint32(65_536) + b[1:-1] * np.uint32(256) + b[2:]) * np.uint32(2_654_435_761)
    return (mixed >> np.uint32(17)).astype(np.int64)


def visible(html: bytes) -> bytes:
    """``html`` without comments, unseen elements, tags and entities, a space for each.

    What is opened and never closed counts as a tag. One way forward: an end that was once not found is not searched for
    again, so a page of open tags takes no longer than any other.
    """
    kept, at, seek, endless = [], 0, 0, set()
    while opened := _OPENS.search(html, seek):
        kind = (opened[1] or opened[2] or b"").lower()
        closed = None
        if kind and kind not in endless:
            closed = _CLOSES[kind].search(html, opened.end())
            if closed is None:
                endless.add(kind)
        end = closed.end() if closed else html.find(b">", opened.end()) + 1
        if not end:  # every kind of end has this sign, so there is none further on
            break
        kept.append(html[at : opened.start()])
        at = seek = end
    kept.append(html[at:])
    return _ENTITY.sub(b" ", b" ".join(kept))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each bucket, from all rows with a language and a text.

    A partition sends one row per language and bucket it has seen; so does the sum over all, to the driver.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                counts = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                counts += np.bincount(triples(t), minlength=BUCKETS)
        for name, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], ["lang", "bucket", "n"]
            )

    let_workers_import(docs.sparkSession)
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    counted = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums: dict[str, np.ndarray] = {}
    for row in counted.toLocalIterator():
        if row.lang not in sums and len(sums) >= MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        sums.setdefault(row.lang, np.zeros(BUCKETS))[row.bucket] = row.n
    languages = sorted(sums)
    counts = np.array([sums[x] for x in languages]).reshape(-1, BUCKETS) + SMOOTHING
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_evidence(html: bytes | None, table: np.ndarray) -> np.ndarray:
    """Tempered log-likelihood of the visible text per language; zeros where there is none."""
    return TEMPER * table[:, triples(visible(html or b""))].sum(axis=1)


def declared_language(html: bytes | None) -> str | None:
    """The first ``lang`` inside an html tag, in lower case. Tags are read one after another, each once."""
    page, at = html or b"", 0
    while tag := _HTML.search(page, at):
        end = page.find(b">", tag.end())
        at = len(page) if end < 0 else end
        if found := _LANG.search(page, tag.end(), at):
            return found[1].decode().lower()
    return None


def softmax(logs: Column) -> Column:
    """Probabilities that belong to an array of logarithms."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(p: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(p)[k]) for k in range(n)))


def with_language(pages: DataFrame, docs: DataFrame, *, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """``key``, lang, probability, text_lang, declared, host of every row of ``pages``, one row each.

    ``docs`` (text, lang) trains the text models. Where a page has no text, declares nothing or has no host, that
    evidence says nothing. Equal probabilities go to the first language in alphabetical order. Without any labelled
    document there are no languages and lang is null.
    """
    languages, table = train(docs)
    n = len(languages)
    if not n:
        nothing = F.lit(None).cast("string")
        host = _host(F.col(url))
        return pages.select(
            key, nothing.alias("lang"), F.lit(None).cast("double").alias("probability"), nothing.alias("text_lang"),
            nothing.alias("declared"), host.alias("host"),
        )
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def make():
        def run(texts):
            kind = pa.struct([("declared", pa.string()), ("logs", pa.list_(pa.float64()))])
            return pa.array(
                [{"declared": declared_language(t), "logs": text_evidence(t, shared.value).tolist()} for t in texts], kind
            )

        return run

    read = pages.select(
        F.col(key).alias("key"),
        _host(F.col(url)).alias("host"),
        text_function(make, "declared string, logs array<double>")(html).alias("x"),
    )
    evidence = written(read.select("key", "host", "x.*", softmax(F.col("x.logs")).alias("p")), "language-evidence")
    rows = _with_priors(evidence, n)
    declared = written(
        evidence.filter("declared is not null").groupBy("declared").agg(_sums("p", n).alias("said")), "declared"
    )
    whole = evidence.filter("declared is not null").agg(F.count("*"), *(F.sum(F.col("p")[k]) for k in range(n))).first()
    of_language = [float(x or 0.0) for x in whole[1:]]
    n_values = declared.count()
    rate = F.array(
        *(
            F.log((F.coalesce(F.col("said")[k], F.lit(0.0)) + DECLARED_SMOOTHING) / (of_language[k] + DECLARED_SMOOTHING * (n_values + 1)))
            for k in range(n)
        )
    )
    # a declared value has two or three letters, so there are at most 18,252 of them
    told = rows.join(F.broadcast(declared), "declared", "left")
    marks = F.when(F.col("declared").isNotNull(), rate).otherwise(F.array(*(F.lit(0.0) for _ in range(n))))
    names = F.array(*map(F.lit, languages))
    best = lambda c: names[F.array_position(F.col(c), F.array_max(c)).cast("int") - 1]
    fused = told.withColumn("marks", marks).withColumn(
        "post", softmax(F.transform("logs", lambda x, k: x + F.col("marks")[k] + F.log(F.col("prior")[k])))
    )
    return fused.select(
        F.col("key").alias(key), best("post").alias("lang"), F.array_max("post").alias("probability"),
        F.when(F.array_max("p") > F.array_min("p"), best("p")).alias("text_lang"), "declared", "host",
    )


def _host(url: Column) -> Column:
    """Host of an address in lower case, '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _with_priors(evidence: DataFrame, n: int) -> DataFrame:
    """``evidence`` with ``prior``: per language, what the other pages of host, domain and suffix say.

    Level sums come from host sums, and each row meets one row of its host; hot hosts are spread.
    """
    hosts = evidence.groupBy("host").agg(F.count("*").alias("n_host"), _sums("p", n).alias("s_host"))
    domain, suffix = F.substring_index("host", ".", -2), F.substring_index("host", ".", -1)
    hosts = written(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")

    def level(by: str) -> DataFrame:
        return hosts.groupBy(by).agg(F.sum("n_host").alias(f"n_{by}"), _sums("s_host", n).alias(f"s_{by}"))

    total = hosts.agg(F.sum("n_host"), *(F.sum(F.col("s_host")[k]) for k in range(n))).first()
    all_n, all_s = float(total[0] or 0), [float(x or 0.0) for x in total[1:]]
    known = hosts.join(level("domain"), "domain").join(level("suffix"), "suffix").withColumn("rows", F.col("n_host"))
    rows = spread_lookup(evidence, known, "host", "rows")
    prior = [(F.lit(all_s[k]) - F.col("p")[k] + 1.0) / (F.lit(all_n) - 1 + n) for k in range(n)]
    for by in ("suffix", "domain", "host"):
        below = [
            (F.col(f"s_{by}")[k] - F.col("p")[k] + LEVEL_WEIGHT * prior[k]) / (F.col(f"n_{by}") - 1 + LEVEL_WEIGHT)
            for k in range(n)
        ]
        name = free_name(rows, f"prior_{by}")
        rows = rows.withColumn(name, F.array(*(F.greatest(x, F.lit(1e-12)) for x in below)))
        prior = [F.col(name)[k] for k in range(n)]
    return rows.withColumn("prior", F.col(name))
