import math
import random
import re
import time
from collections import defaultdict

import numpy as np

from snapfold.llm import language
from snapfold.llm.queries import op1_language_id

TEXTS = {"en": "the reader of the page thinks that this is the thing with the words", "de": "der leser der seite denkt dass dieses das ding mit den wörtern ist und nicht"}


def labelled(spark):
    return spark.createDataFrame([(k, t, la) for la, t in TEXTS.items() for k in range(5)] + [(9, None, "en"), (10, "x", None)],
                                 "doc_id long, text string, lang string")


def pages(spark, rows, extra=""):
    return spark.createDataFrame([(*r, *(["x"] * bool(extra))) for r in rows], f"page_id long, url string, html string{extra}")


def page(lang, text, declared=None):
    return f"<html{f' lang={declared}' if declared else ''}><head><script>the the the</script></head><p>{text}</p></html>"


def softmax(logs):
    raised = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(raised) for x in raised]


def brute_force(rows, table, n):
    """The same fusion, page by page in plain Python."""
    seen = []
    for key, url, html in rows:
        raw = html.encode() if html else b""
        host = ""
        if url and "://" in url:
            host = url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
        logs = language.text_evidence(raw, table).tolist()
        parts = host.split(".")
        seen.append((key, host, ".".join(parts[-2:]), parts[-1], language.declared_language(raw), logs, softmax(logs)))
    sums = [defaultdict(lambda: [0, [0.0] * n]) for _ in range(4)]  # all, suffix, domain, host
    said, told = defaultdict(lambda: [0.0] * n), [0.0] * n
    for _, host, domain, suffix, declared, _, p in seen:
        for s, by in zip(sums, ("", suffix, domain, host), strict=True):
            s[by][0] += 1
            s[by][1] = [a + b for a, b in zip(s[by][1], p, strict=True)]
        if declared:
            said[declared] = [a + b for a, b in zip(said[declared], p, strict=True)]
            told = [a + b for a, b in zip(told, p, strict=True)]
    out = {}
    for key, host, domain, suffix, declared, logs, p in seen:
        total, all_p = sums[0][""]
        prior = [(all_p[k] - p[k] + 1) / (total - 1 + n) for k in range(n)]
        for s, by in zip(sums[1:], (suffix, domain, host), strict=True):
            m, q = s[by]
            w = language.LEVEL_WEIGHT
            prior = [max((q[k] - p[k] + w * prior[k]) / (m - 1 + w), 1e-12) for k in range(n)]
        a = language.DECLARED_SMOOTHING
        marks = [math.log((said[declared][k] + a) / (told[k] + a * (len(said) + 1))) if declared else 0.0 for k in range(n)]
        out[key] = softmax([x + y + math.log(z) for x, y, z in zip(logs, marks, prior, strict=True)])
    return out


ROWS = [
    (1, "https://a.x.de/1", page("en", TEXTS["en"], "en")), (2, "https://b.x.de/2", page("de", TEXTS["de"], "de")),
    (3, "HTTP://B.x.de:80?q", page("de", "", "de")), (4, "http://u@b.x.de#f", page("de", TEXTS["de"])), (5, None, None),
    (6, "no address", ""), (7, "https://b.x.de/7", page("en", "the", "de")), (8, "https://c.com", page("en", TEXTS["en"] * 400, "en")),
    (9, "https://c.com", page("en", TEXTS["en"], "DE-at")),
]


def test_fusion_against_brute_force(spark):
    languages, table = language.train(labelled(spark))
    assert languages == ["de", "en"] and np.allclose(np.exp(table).sum(axis=1), 1)
    out = language.with_language(pages(spark, ROWS, ", host string"), labelled(spark)).collect()
    expected = brute_force(ROWS, table, 2)
    assert len(out) == len(ROWS)
    for r in out:
        post = expected[r.page_id]
        assert r.lang == languages[post.index(max(post))]
        assert math.isclose(r.probability, max(post), rel_tol=1e-6)
    found = {r.page_id: r for r in out}
    assert found[3].lang == "de" and found[3].text_lang is None  # markup and host speak where there is no text
    assert found[9].declared == "de" and found[9].lang == "en"  # the text outweighs one wrong mark


def test_repeated_pages_and_ids(spark):
    rows = [(1, "https://a.de", page("de", TEXTS["de"], "de"))] * 3 + [(None, "https://a.de", None)]
    out = language.with_language(pages(spark, rows), labelled(spark)).collect()
    assert sorted((str(r.page_id), r.lang) for r in out) == [("1", "de")] * 3 + [("None", "de")]


def test_empty_tables(spark):
    assert language.with_language(pages(spark, []), labelled(spark)).count() == 0
    out = language.with_language(pages(spark, ROWS[:1]), labelled(spark).limit(0)).collect()
    assert [(r.page_id, r.lang, r.host) for r in out] == [(1, None, "a.x.de")]


def test_query_agrees_with_the_markup(spark, data):
    rows = op1_language_id(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/pages.parquet").count()
    assert sum(r.lang == r.declared for r in rows) >= 0.95 * len(rows)


HIDDEN = re.compile(
    rb"<!--.*?-->|<(script|style|nav|header|footer|aside|template|title)\b.*?</\1\s*>|<[^>]*>", re.DOTALL | re.IGNORECASE
)
DECLARED = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.IGNORECASE)


def test_tags_against_one_pattern():
    rng = random.Random(4)
    parts = [b"<nav>", b"</nav >", b"</NAV>", b"<!--", b"-->", b"<", b">", b" word ", b"<script x>", b"</script>", b"<navy>", b"&amp;",
             b"<html ", b"lang", b"=", b" lang='en'", b"xlang=de", b"</", b"\n"]
    for _ in range(5000):
        html = b"".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert language.visible(html) == re.sub(rb"&[A-Za-z0-9#]+;", b" ", HIDDEN.sub(b" ", html))
        found = DECLARED.search(html)
        assert language.declared_language(html) == (found[1].decode().lower() if found else None)


def test_pages_of_open_tags_take_linear_time():
    start = time.process_time()
    for part in (b"<nav>", b"<!--", b"<", b"<html ", b"</nav ", b"<nav><aside><!--><title>"):
        page = part * (10_000_000 // len(part))
        language.visible(page)
        assert language.declared_language(page) is None
    assert time.process_time() - start < 60
