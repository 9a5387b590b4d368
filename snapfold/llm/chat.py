"""Reply trees to training conversations: root-to-leaf paths, ranked, each formatted as one text with a loss mask.

Messages name the message they reply to. Self-joins that double their reach in every round give each message its
ancestor one, two, four ... steps up, with the depth and the sum of the scores in between; a chain of a thousand
messages takes ten rounds. The leaves of a tree are ranked by the score of their path, and the messages of the chosen
paths are gathered by the same tables: what lies within 2^k steps above a leaf, joined to its ancestors 2^k steps up,
is what lies within 2^(k+1) steps. So no round carries texts, and a path costs as many rows as it has messages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapfold.llm.rows import let_workers_import, written

#: Role whose texts lie under the loss mask.
LEARNED = "assistant"

_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_READ = pa.struct([("turns", _TURNS), ("loss_text", pa.string())])
_READ_TYPE = "turns array<struct<role:string,text:string>>, loss_text string"


@dataclass(frozen=True)
class Template:
    """The strings around a turn, and other control strings that must not appear in a text as they are.

    In roles and texts a control string gets one more ``escape`` after its first character, however many stand there
    already, so nothing a text holds reads as a marker and taking one away gives the text back.
    """

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    # Control strings of widely used chat templates.
    others: tuple[str, ...] = (
        "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    )
    escape: str = "\\"

    def __post_init__(self):
        if len(self.escape) != 1 or any(len(s) < 2 or self.escape in s for s in self.strings):
            raise ValueError("control strings need two characters or more, and none of them the escape")
        for s in self.strings:
            for t in self.strings:
                if any(t.startswith(s[k:]) or s[k:].startswith(t) for k in range(1, len(s))):
                    raise ValueError(f"{t!r} may overlap {s!r}")

    @property
    def strings(self) -> tuple[str, ...]:
        return self.turn, self.body, self.end, *self.others

    def pattern(self, escapes: str) -> str:
        """Control strings with ``escapes`` (a quantifier) escape characters in them, in three groups."""
        rests = "|".join(re.escape(r) for r in sorted({s[1:] for s in self.strings}, key=len, reverse=True))
        firsts = "".join(re.escape(c) for c in sorted({s[0] for s in self.strings}))
        return f"([{firsts}])({re.escape(self.escape)}{escapes})({rests})"

    def escaped(self, text: Column) -> Column:
        safe = re.sub(r"([\\$])", r"\\\1", self.escape)
        return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), self.pattern("*"), f"$1{safe}$2$3")

    def unescaped(self, text: str) -> str:
        return re.sub(self.pattern("+"), lambda m: m[1] + m[2][1:] + m[3], text)

    def parsed(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a formatted conversation."""
        turns = []
        for piece in formatted.split(self.turn)[1:]:
            role, _, rest = piece.partition(self.body)
            turns.append((self.unescaped(role), self.unescaped(rest.removesuffix(self.end))))
        return turns


def chains(conversations: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations without branches as messages that each reply to the one before.

    ``(tree, node, parent, score, role, text)``: places from 1 by ``turn`` (rows without one first; rows of one turn
    by role and text). Rows without a conversation id are one conversation.
    """
    order = Window.partitionBy(tree).orderBy(turn, "role", "text")
    placed = conversations.select(
        F.col(tree).alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text"
    )
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return placed.select("tree", "node", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def ancestors(messages: DataFrame) -> list[DataFrame]:
    """Tables ``(tree, node, up, depth, total)`` for k = 0, 1, ...: ``up`` is the ancestor 2^k steps up, null beyond the root.

    ``depth`` and ``total`` count the messages and sum the scores from the message up to, not including, ``up``; in
    the last table that is the whole path. A message in a circle of replies, or below one, keeps an ``up`` for ever.
    """
    given = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    known = _renamed(given, tree="t", node="n")
    linked = given.join(known, _same("tree", "t") & (F.col("parent") == F.col("n")), "left")
    state = written(linked.select("tree", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("depth"), "total"), "replies")
    tables, before = [state], None
    while True:
        open_ = state.filter("up is not null")
        now = open_.count()
        # while replies form trees, every doubling reaches the root of some message
        if now in (0, before):
            return tables
        above = _renamed(state, tree="t", node="n", up="far", depth="d", total="s")
        further = open_.join(above, _same("tree", "t") & (F.col("up") == F.col("n")))
        state = written(
            further.select(
                "tree", "node", F.col("far").alias("up"), (F.col("depth") + F.col("d")).alias("depth"),
                (F.col("total") + F.col("s")).alias("total"),
            ).unionByName(state.filter("up is null")),
            "replies",
        )
        tables.append(state)
        before = now


def reply_paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """``(tree, path, place, node, total)``: the messages of the ``keep`` best paths of every tree, all where None.

    ``messages`` has tree, node, parent and score. A path leads from a root (no parent, or one that is not there) to a
    leaf (nobody's parent); ``path`` ranks it from 1 by ``total``, the sum of its scores (null: 0), highest first, equal
    ones by the id of the leaf; ``place`` counts from the root. Rows without a node are no messages, of repeated ids
    the row smallest by (parent, score) stays. Messages in or below a circle of replies have no path.
    """
    nodes = messages.filter("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("m"))
    tables = ancestors(nodes.select("tree", "node", "m.parent", "m.score"))
    replied = _renamed(tables[0].filter("up is not null"), tree="t", up="n").distinct()
    leaves = tables[-1].filter("up is null").join(replied, _same("tree", "t") & (F.col("node") == F.col("n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    ranked = leaves.withColumn("path", rank)
    chosen = ranked if keep is None else ranked.filter(F.col("path") <= keep)
    found = written(chosen.select("tree", "path", F.col("depth").alias("place"), "node", "total"), "paths")
    for k, table in enumerate(tables[:-1]):
        above = _renamed(table.filter("up is not null"), tree="t", node="n", up="up")
        higher = found.join(above, _same("tree", "t") & (F.col("node") == F.col("n")))
        higher = higher.select("tree", "path", (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("node"), "total")
        found = written(found.unionByName(higher), "paths")
    return found


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``(tree, path, n_turns, formatted, loss)`` from ``(tree, path, place, role, text)``, one row per path.

    ``loss`` lists the code-point spans (start, end exclusive) of the learned texts in ``formatted``, in order. Null
    roles and texts are empty. A conversation is one string and thereby bounded by what a row holds, 2 GB.
    """
    head = F.concat(F.lit(template.turn), template.escaped(F.col("role")), F.lit(template.body))
    marked = turns.select(
        "tree", "path", "place", head.alias("head"), template.escaped(F.col("text")).alias("body"),
        (F.coalesce("role", F.lit("")) == LEARNED).alias("learned"),
    )
    before = Window.partitionBy("tree", "path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(template.end)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    placed = marked.withColumn("start", start).withColumn("end", F.col("start") + F.length("body"))
    pieces = F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(template.end)).alias("piece"))))
    spans = F.array_sort(F.collect_list(F.when(F.col("learned"), F.struct("start", "end"))))
    whole = placed.groupBy("tree", "path").agg(F.count("*").alias("n_turns"), pieces.alias("pieces"), spans.alias("loss"))
    return whole.select("tree", "path", "n_turns", F.array_join("pieces.piece", "").alias("formatted"), "loss")


def format_trees(messages: DataFrame, keep: int | None = 1, template: Template = Template()) -> DataFrame:
    """The ``keep`` best paths of every tree, formatted: ``(tree, path, total, n_turns, formatted, loss)``.

    ``messages``: tree, node, parent, score, role, text; other columns are not read. Of rows that repeat an id the one
    smallest by (parent, score, role, text) is formatted. An empty table gives an empty one.
    """
    given = messages.select("tree", "node", "parent", F.col("score").cast("double").alias("score"), "role", "text")
    paths = reply_paths(given, keep)
    row = F.min(F.struct("parent", "score", "role", "text")).alias("m")
    texts = given.filter("node is not null").groupBy("tree", "node").agg(row)
    texts = texts.select(F.col("tree").alias("t"), F.col("node").alias("n"), "m.role", "m.text")
    told = paths.join(texts, _same("tree", "t") & (F.col("node") == F.col("n")))
    totals = _renamed(paths.filter("place = 1"), tree="t", path="p", total="total")
    shaped = formatted(told, template).join(totals, _same("tree", "t") & (F.col("path") == F.col("p")))
    return shaped.select("tree", "path", "total", "n_turns", "formatted", "loss")


def read_back(chats: DataFrame, out: str, template: Template = Template()) -> DataFrame:
    """``chats`` with a struct ``out`` read from ``formatted`` and ``loss`` alone: its turns and the text under the mask.

    Markers and escapes are taken off again. A column already named ``out`` is replaced.
    """
    let_workers_import(chats.sparkSession)

    @F.arrow_udf(_READ_TYPE)
    def read(texts: pa.Array, spans: pa.Array) -> pa.Array:
        found = []
        for text, loss in zip(texts, spans, strict=True):
            line = text.as_py()
            learned = (template.unescaped(line[s["start"] : s["end"]]) for s in loss.as_py())
            turns = [{"role": r, "text": t} for r, t in template.parsed(line)]
            found.append({"turns": turns, "loss_text": "".join(learned)})
        return pa.array(found, _READ)

    return chats.withColumn(out, read("formatted", "loss"))


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted texts say, read back from them: per conversation its turns and its learned text, as digests.

    ``masked_chars`` counts the characters under the mask as they stand, escapes included.
    """
    told = read_back(chats, "read", template)
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    masked = F.aggregate("loss", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return told.select(
        F.col("tree").alias("conv_id"),
        F.size("read.turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read.turns", turn), ""), 256).alias("turns_sha256"),
        F.length("read.loss_text").cast("long").alias("loss_chars"),
        F.sha2("read.loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        masked.alias("masked_chars"),
    )
