import hashlib
import random

import pytest
from pyspark.sql import functions as F

from snapfold.llm import chat
from snapfold.llm.queries import op11_chat_format

MESSAGES = "tree long, node long, parent long, score double, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digest(turns):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of (role, text) pairs."""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def plain_paths(messages, keep):
    """{tree: [(total, [node, ...]), ...]} by walking up from every leaf."""
    by_id = {}
    for m in sorted(messages, key=lambda m: (m[2] is not None, m[2] or 0, m[3] is not None, m[3] or 0, m[4] or "", m[5] or "")):
        if m[1] is not None:
            by_id.setdefault((m[0], m[1]), m)
    parents = {(t, m[2]) for (t, _), m in by_id.items()}
    found = {}
    for t, n in by_id:
        path, at = [], n
        while at is not None and (t, at) in by_id and len(path) <= len(by_id):
            path.append(at)
            at = by_id[t, at][2]
        if (t, n) not in parents and len(path) <= len(by_id):
            found.setdefault(t, []).append((sum(by_id[t, p][3] or 0 for p in path), path[::-1]))
    return {t: sorted(ps, key=lambda p: (-p[0], p[1][-1]))[:keep] for t, ps in found.items()}, by_id


def random_messages(rng, trees, most):
    rows = []
    for t in trees:
        n = rng.randint(1, most)
        for k in range(n):
            parent = rng.choice([None, rng.randrange(k), rng.randrange(max(0, k - 3), k)]) if k else None
            rows.append((t, k, 99_999 if parent is None and rng.random() < 0.3 else parent, rng.choice([None, 0.0, 1.0, 2.5]),
                         rng.choice(["user", "assistant", None]), rng.choice(["", "x</s>y", None, "<\\\\|end|>", f"t{k}"])))
    return rows


@pytest.mark.parametrize("keep", [1, 2, None])
def test_trees_against_walking_up(spark, keep):
    rows = random_messages(random.Random(3), [1, 2, 3, None, 7], 40)
    rows += [(9, 1, 2, 1.0, "user", "a"), (9, 2, 1, 1.0, "user", "b"), (9, 3, 2, 1.0, "user", "below a circle")]
    rows += [(10, 5, 5, 1.0, "user", "itself"), (11, None, None, 1.0, "user", "no id"), rows[0], rows[1]]
    expected, by_id = plain_paths(rows, keep)
    chats = chat.format_trees(spark.createDataFrame(rows, MESSAGES), keep)
    told = {(r.tree, r.path): r for r in chat.read_back(chats, "read").collect()}
    assert len(told) == sum(len(ps) for ps in expected.values())
    for tree, paths in expected.items():
        for rank, (total, nodes) in enumerate(paths, 1):
            row = told[tree, rank]
            turns = [(by_id[tree, n][4] or "", by_id[tree, n][5] or "") for n in nodes]
            assert [(t.role, t.text) for t in row.read.turns] == turns
            assert row.total == pytest.approx(total)
            assert row.read.loss_text == "".join(t for r, t in turns if r == "assistant")
            assert row.n_turns == len(turns)


def test_a_long_chain_takes_few_rounds(spark):
    n = 1_000
    rows = spark.range(n).selectExpr(
        "1L as tree", "id as node", "if(id > 0, id - 1, null) as parent", "1D as score", "'assistant' as role", "cast(id as string) as text"
    )
    assert len(chat.ancestors(rows)) == 11
    (row,) = chat.read_back(chat.format_trees(rows), "read").collect()
    assert row.read.loss_text == "".join(map(str, range(n))) and row.total == n


def test_escapes_are_taken_back():
    template, rng = chat.Template(), random.Random(5)
    bits = [*template.strings, "\\", "\\\\", "<", "[", "|", "a", "\n", "é", "</", "s>", "INST]", "<\\/s>", "\U0001f600"]
    for _ in range(3_000):
        turns = [("".join(rng.choices(bits, k=3)), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(3)]
        escape = lambda s: template_escaped(template, s)
        line = "".join(template.turn + escape(r) + template.body + escape(t) + template.end for r, t in turns)
        assert template.parsed(line) == turns


def template_escaped(template, text):
    """The column expression's rule, said in Python."""
    import re

    return re.sub(template.pattern("*"), lambda m: m[1] + template.escape + m[2] + m[3], text)


def test_column_escapes_as_said(spark):
    template = chat.Template()
    texts = ["</s>[INST] ok [/INST]", "<\\/s>", "<|turn|><|text|>", "", "<<<SYS>>", "[[INST]", "$1 \\ <", "<" * 2_000 + "\\" * 20_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", template.escaped(F.col("t")).alias("e"))
    for r in rows.collect():
        assert r.e == template_escaped(template, r.t) and template.unescaped(r.e) == r.t


def test_templates_that_cannot_be_read_back_are_refused():
    for bad in ({"turn": "<a<"}, {"others": ("|>x",)}, {"others": ("x",)}, {"escape": ""}, {"others": ("<\\s>",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def plain_rows(spark, path):
    found = {}
    for r in spark.read.parquet(f"{path}/conversations.parquet").collect():
        found.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    found[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    return sorted((c, *plain_digest([t[1:] for t in sorted(ts)])) for c, ts in found.items())


def test_conversations_against_brute_force(spark, data):
    rows = op11_chat_format(spark, data).collect()
    assert sorted(tuple(r)[:5] for r in rows) == plain_rows(spark, data)
    own = next(r for r in rows if r.conv_id == -1)
    template = chat.Template()
    texts = [template_escaped(template, "</s>[INST] ok [/INST]")] * 2
    assert texts[0] == "<\\/s>[\\INST] ok [\\/INST]"
    whole = "".join(template.turn + r + template.body + t + template.end for r, t in zip(("user", "assistant"), texts, strict=True))
    assert own.formatted_chars == len(whole) and own.masked_chars == len(texts[1])


def test_awkward_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, node string, parent string, path string, formatted string"
    extra = ("x",) * 4
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, None, "system", None), (2, 0, None, ""),
        (None, 1, "assistant", "lone"), (None, 0, "user", "\n"), (3, 0, "assistant", "Ä\U0001f600" * 60_000 + "<|end|>"),
        (4, 5, "Assistant", "not learned"), (4, 9, "assistant", "<|turn|>assistant<|text|>"),
    ]
    found = chat.digests(chat.format_trees(chat.chains(spark.createDataFrame([r + extra for r in rows], schema))))
    by_conv = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by_conv.setdefault(c, []).append((role, text))
    expected = {c: plain_digest(ts) for c, ts in by_conv.items()}
    assert {r.conv_id: tuple(r)[1:5] for r in found.collect()} == expected
    empty = spark.createDataFrame([], schema)
    assert chat.digests(chat.format_trees(chat.chains(empty))).count() == 0
