import random

import pytest
from tokenizers import Tokenizer

from snapfold.llm import bpe
from snapfold.llm.queries import BPE_FILE, op4_bpe


@pytest.fixture(scope="module")
def codec():
    with open(BPE_FILE, "rb") as file:
        return bpe.Codec(bpe.automaton_from_json(file.read()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_FILE)


def texts(n=3_000):
    rng = random.Random(5)
    kinds = ["aaab ", "eiou thsx", "  \n\t\r\v\x1c\x85\xa0 　", "'srtlldve", "0123½²٣", "éüßñ中文", "🙂👩‍👧﻿", ".,!?&$#*"]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_ids_are_those_of_the_library(codec, library):
    for text in [*texts(), "hi <|endoftext|> there<|endoftext|><|endoftext|> ", "a" * 5_000, "x y " * 5_000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_every_letter_splits_like_the_library(codec, library):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    strings = ["a" + chr(c) + "1 " + chr(c) + "!" + chr(c) + " " for c in points]
    for text, row in zip(strings, library.encode_batch(strings, add_special_tokens=False), strict=True):
        assert codec.encode(text) == row.ids


def plain_bpe(word, merges):
    parts = [bytes([b]) for b in word]
    for a, b in merges:  # rank by rank, from left to right
        k = 0
        while k + 1 < len(parts):
            if (parts[k], parts[k + 1]) == (a, b):
                parts[k : k + 2] = [a + b]
            k += 1
    return parts


def test_small_automata_against_merging():
    rng = random.Random(3)
    for _ in range(60):
        tokens = [b"a", b"b", b"c"]
        merges = []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        made = bpe.TokenAutomaton({t: k for k, t in enumerate(tokens)}, merges, {})
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            assert [made.labels[t] for t in made.encode_word(word)] == plain_bpe(word, merges)


def test_only_accepted_sequences_follow_arcs(codec):
    a = codec.automaton
    ids = codec.encode("unbelievable")
    assert all(a.arc(x, y) for x, y in zip(ids, ids[1:], strict=False))
    h, e = codec.encode("h")[0], codec.encode("e")[0]
    assert not a.arc(h, e)  # 'he' is a merge, so its halves never stand side by side


def test_memory_turns_over(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Codec(codec.automaton)
    for text in texts(300):
        assert small.encode(text) == codec.encode(text)


def test_a_token_made_twice_is_refused():
    with pytest.raises(ValueError):
        bpe.TokenAutomaton({b"a": 0, b"aa": 1, b"aaa": 2}, [(b"a", b"a"), (b"aa", b"a"), (b"a", b"aa")], {})


def test_awkward_rows(spark, docs_of, library):
    pairs = [(1, None), (2, ""), (3, "a  b\n"), (3, "a  b\n"), (None, "x"), (4, "word " * 50_000)]
    docs = docs_of(pairs, extra=("ids", "decoded", "coded"))
    rows = bpe.encoded(docs, BPE_FILE).collect()
    assert len(rows) == len(pairs)
    for row in rows:
        assert row.ids == (library.encode(row.text, add_special_tokens=False).ids if row.text else [])
        assert row.decoded == (row.text or "")
    assert bpe.encoded(docs_of([]), BPE_FILE).count() == 0


def test_decoding_tables(spark, library):
    tokens = spark.createDataFrame([([15496, 995],), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decoded_texts(tokens, BPE_FILE).collect()] == ["Hello world", "", None]


def test_query_digests(spark, data, library):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op4_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
