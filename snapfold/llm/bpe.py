"""Byte-level BPE as a token automaton built merge by merge, and its transitions over text.

The automaton reads token sequences and accepts exactly those that BPE produces. It starts as one state in which
every byte loops. The merge of rank r, (u, v) -> uv, is a gadget on it: the state T(u) that u-arcs lead to is
copied without its v-arc, all u-arcs are led to the copy, and every state with a u-arc gets a uv-arc to T(v) as it
was. So each token has one target state, a state differs from the one it was copied from by one missing arc, and
the whole automaton is, per token, the arcs taken from its state with the rank at which they went.

A word is encoded by walking a byte trie of the arc labels from each position and following the arcs of the
automaton between positions. Each prefix of a word has one accepted path, so the walk is deterministic: a position
holds one token. Decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.rows import free_name, text_function

#: Entries that half of a task's memory of words holds.
REMEMBERED = 200_000
#: Fixed value: the split of byte-level BPE before its merges.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: The same for texts of the first 256 code points, where the classes can be written out.
LATIN_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+"
    r"| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class TokenAutomaton:
    """``vocabulary``: byte label -> id. ``merges``: pairs of byte labels by rank. ``specials``: text -> id."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], specials: dict[str, int]):
        self.labels = {i: b for b, i in vocabulary.items()} | {i: s.encode() for s, i in specials.items()}
        self.specials = specials
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.gone: dict[int, dict[int, int]] = {}  # token -> arc taken from its state -> rank at which it went
        self.dead: set[int] = set()
        self._arcs: dict[int, bool] = {}
        for i, (a, b) in enumerate(merges):
            self._gadget(i, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self._arcs.clear()
        self._trie(vocabulary)

    def _gadget(self, i: int, u: int, v: int, uv: int) -> None:
        if uv in self.rank:
            raise ValueError(f"merge {i} makes a token that an earlier merge has made")
        open_arc = not {u, v} & self.dead and self._arc(u, v)  # else u and v never stand side by side by now
        self.left[uv], self.right[uv], self.rank[uv] = u, v, i
        if open_arc:
            self.gone.setdefault(u, {})[v] = i
        else:
            self.dead.add(uv)

    def _arc(self, state: int, token: int) -> bool:
        """Whether the state that ``state``-arcs lead to has a ``token``-arc.

        The state of a merged token is that of its right half when the merge came, so of the right half's lost arcs
        only those of lower rank count; and a merged token inherits its arcs from its left half when it came.
        """
        z, before = state, len(self.rank) + 1
        while z is not None:
            lost = self.gone.get(z)
            if lost:
                y, until = token, len(self.rank) + 1
                while y is not None:
                    if lost.get(y, until) < min(before, until) or lost.get(y, -1) == until < before:
                        return False
                    until, y = self.rank.get(y, -1), self.left.get(y)
            before, z = self.rank.get(z, -1), self.right.get(z)
        return True

    def arc(self, state: int, token: int) -> bool:
        key = state << 32 | token
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) > 1_000_000:
                self._arcs.clear()
            known = self._arcs[key] = self._arc(state, token)
        return known

    def _trie(self, vocabulary: dict[bytes, int]) -> None:
        """Byte trie of the labels: a node maps a byte to its child, and -1 to the label that ends there."""
        self.root: dict = {}
        self.length = {t: len(label) for label, t in vocabulary.items()}
        for label, token in vocabulary.items():
            if token not in self.dead and (token in self.rank or len(label) == 1):
                node = self.root
                for byte in label:
                    node = node.setdefault(byte, {})
                node[-1] = token
        self.shorter = {}  # the longest label that a label begins with
        for label, token in vocabulary.items():
            node, self.shorter[token] = self.root, -1
            for byte in label[:-1]:
                node = node.get(byte, {})
                self.shorter[token] = node.get(-1, self.shorter[token])

    def encode_word(self, word: bytes) -> list[int]:
        """The accepted path over ``word``: the longest label first, one step back where no arc goes on.

        A prefix of the word has one accepted path, so a position that led nowhere is never entered again.
        """
        root, known, length, shorter, n = self.root, self._arcs, self.length, self.shorter, len(word)
        path, ends, closed, at, last, token = [], [0], (), 0, -1, -1
        while at < n:
            if token < 0:  # the longest label from here
                node, to = root, at
                while to < n and (node := node.get(word[to])) is not None:
                    token = node.get(-1, token)
                    to += 1
                if token < 0:
                    raise ValueError("the vocabulary lacks a byte of this word")
            while token >= 0:
                to = at + length[token]
                if to not in closed:
                    if last < 0:
                        break
                    arc = known.get(last << 32 | token)
                    if arc or (arc is None and self.arc(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                ends.append(to)
                at, last, token = to, token, -1
                continue
            closed = closed or set()
            while token < 0:  # every byte is a label, so an open path exists and this ends
                closed.add(at)
                ends.pop()
                at = ends[-1]
                token = shorter[path.pop()]
            last = path[-1] if path else -1
        return path


def automaton_from_json(content: bytes) -> TokenAutomaton:
    """From the content of a ``tokenizer.json`` with a byte-level BPE model."""
    read = json.loads(content)
    model, letters = read["model"], byte_letters()
    split = read.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or read.get("normalizer"):
        raise ValueError("not a plain byte-level BPE file")
    specials = {x["content"]: x["id"] for x in read["added_tokens"]}
    spell = lambda token: bytes(letters[c] for c in token)
    merges = [(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
    vocabulary = {spell(k): v for k, v in model["vocab"].items() if k not in specials}
    return TokenAutomaton(vocabulary, [(spell(a), spell(b)) for a, b in merges], specials)


class _Memory(dict):
    """Word -> packed ids. Words not used since the last two turnovers are forgotten."""

    def __init__(self, find):
        self.find, self.old = find, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        packed = self[key] = self.old.get(key) or self.find(key)
        return packed


class Codec:
    """Texts to ids and back, with a memory of words."""

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton
        self.split = regex.compile(WORD_PATTERN).findall
        self.split_latin = re.compile(LATIN_PATTERN).findall
        self.words = _Memory(lambda word: array("i", automaton.encode_word(word.encode())).tobytes())
        by_length = sorted(automaton.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        return self.split_latin(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pieces(text)))

    def packed(self, text: str) -> bytes:
        if self.special is None or not any(s in text for s in self.automaton.specials):
            return self._plain(text)
        out = []
        for n, part in enumerate(self.special.split(text)):
            out.append(array("i", [self.automaton.specials[part]]).tobytes() if n % 2 else self._plain(part))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.automaton.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(content: bytes) -> Codec:
    codec = Codec(automaton_from_json(content))
    gc.freeze()  # the trie stays for the life of the worker; no need to search it for garbage
    return codec


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.fromiter(accumulate((len(p) // 4 for p in parts), initial=0), dtype=np.int32, count=len(parts) + 1)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def encoded(docs: DataFrame, tokenizer_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of ``text`` and what they decode to, in the columns ``ids`` and ``decoded``.

    A null or empty text has no ids and decodes to ''. Columns of these names are replaced. The file is read here
    and sent along; a vocabulary is a few MB.
    """
    with open(tokenizer_file, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        codec = _codec(content.value)

        def run(texts):
            parts = [codec.packed(t.decode()) if t else b"" for t in texts]
            lists = _lists(parts)
            back = [codec.decode(np.frombuffer(p, dtype=np.int32).tolist()) for p in parts]
            return pa.StructArray.from_arrays([lists, pa.array(back, pa.string())], ["ids", "decoded"])

        return run

    both = text_function(make, "ids array<int>, decoded string")(text)
    rest = [c for c in docs.columns if c.lower() not in (ids.lower(), decoded.lower())]
    coded = free_name(docs, "coded")
    return docs.withColumn(coded, both).select(
        *rest, F.col(f"{coded}.ids").alias(ids), F.col(f"{coded}.decoded").alias(decoded)
    )


def decoded_texts(tokens: DataFrame, tokenizer_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text that its id lists decode to; null lists give null."""
    with open(tokenizer_file, "rb") as file:
        content = tokens.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        codec = _codec(content.value)
        return pa.array([None if x is None else codec.decode(x) for x in lists.to_pylist()], pa.string())

    return tokens.withColumn(out, decode(ids))

