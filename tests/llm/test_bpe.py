"""Encoding and decoding against the tokenizers library; token counts against greedy matching; words of the packing encoder."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from matchloom.llm import bpe, packing, token_counts
from matchloom.llm.queries import vocabulary

ODD = [
    None, "", " ", "\n", "a", "a<|endoftext|>b  c", "<|endoftext|>", "  x\n\n y z   q", "don't WE'LL I'm 123 ½²x Ⅷ", "é 日本語 ！\x1c\x1d z", "\x85 a", "aaaaaaaaaa aaaaaaa", "İstanbul ΣΑΣ ß",
    "x​‍y 👩‍👩‍👧 \U0001f600", "tab\tand\x0bvt\x0cff\r\n", "a.b. c", "!. x, y", "U.S. is", ".. . ,, ., a", "İ. x", "é, É. ́. q", "x_. y", "I'll.\nx.", "ﬁ. ﬁ", "\x1c. y", ".,", "क़. क़", "Ａ．　x", "it's 'tis rock'n'roll", "#$%&&& ***the&&&",
]


def texts():
    rng = random.Random(8)
    pieces = ["the", " quick", "Brown", "fox's", "über", "ñandú", "123", "4,5", "--", "\n", "  ", "…", "don't", "ЖЗ", "日本", "é", "&amp;", "<|endoftext|>"]
    made = ["".join(rng.choice(pieces) + rng.choice([" ", "", " "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return ODD + made + ["long word " * 30_000, "a" * 5000]


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def ids(raw, kind="<u4"):
    return np.frombuffer(raw, dtype=kind).tolist()


def test_byte_bpe_is_the_librarys():
    lib, own, rows = library("byte_bpe_50k.json"), bpe.ByteBPE(vocabulary("byte_bpe_50k.json")), texts()
    found = own.encode_batch(rows)
    for t, raw in zip(rows, found):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert ids(raw) == want, t
        assert own.decode(raw) == lib.decode(want, skip_special_tokens=False)
    assert own.encode_batch(rows) == found  # from the cache
    assert own.encode_batch([]) == []


def test_cache_size_changes_nothing(monkeypatch):
    own, rows = bpe.ByteBPE(vocabulary("byte_bpe_50k.json")), texts()
    want = own.encode_batch(rows)
    monkeypatch.setattr(bpe, "PIECES", 3)
    assert [own.encode_batch([t])[0] for t in rows] == want


def test_round_trip_query_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:40])] + [(7, "twice"), (7, "twice"), (None, "no id")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, ids string")
    lib = library("byte_bpe_50k.json")
    path = vocabulary("byte_bpe_50k.json")
    got = sorted((tuple(r) for r in bpe.round_trip(df, path).collect()), key=str)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for d, t in rows:
        e = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(e), sha(np.array(e, "<u4").tobytes()), sha(lib.decode(e, skip_special_tokens=False).encode())))
    assert got == sorted(want, key=str)
    again = bpe.decode(bpe.encode(df, path), path)
    assert sorted(str(tuple(r)) for r in again.collect()) == sorted(str((d, lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False))) for d, t in rows)
    assert bpe.round_trip(df.limit(0), path).count() == 0


def test_word_encoder_is_the_librarys(monkeypatch):
    lib, own, rows = library("word_bpe_49k.json"), packing.WordEncoder(vocabulary("word_bpe_49k.json")), texts()
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert [ids(x, own.kind) for x in own.encode(rows)] == want
    monkeypatch.setattr(packing, "WORDS", 2)
    assert [ids(own.encode([t])[0], own.kind) for t in rows] == want


def greedy(word, begin, go_on):
    n, i = 0, 0
    while i < len(word):
        known = begin if i == 0 else go_on
        j = len(word)
        while j > i and word[i:j] not in known:
            j -= 1
        if j == i:
            return None
        i, n = j, n + 1
    return n


def test_counts_are_greedy_longest_match(spark):
    path = vocabulary("byte_bpe_50k.json")
    own = token_counts.from_byte_vocabulary(path)
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    symbols = bpe.byte_symbols()
    tokens = {bytes(symbols[c] for c in t) for t in vocab if all(c in symbols for c in t)}
    begin = {t for t in tokens if t.startswith(b" ")}
    rows = texts()
    for w in {w for t in rows if t for w in t.encode().split()}:
        if len(w) < 400:
            assert own.count(b" " + w) == greedy(b" " + w, begin, tokens), w
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)] + [(None, "x y", 1)], "doc_id long, text string, n_words int")
    for r in token_counts.count_tokens(df, path).collect():
        t = "x y" if r["doc_id"] is None else rows[r["doc_id"]] or ""
        words = t.encode().split()
        assert r["n_words"] == len(words)
        if len(t) < 4000:
            assert r["n_tokens"] == sum(greedy(b" " + w, begin, tokens) for w in words)
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_automaton_on_random_vocabularies(seed):
    rng = random.Random(seed)
    draw = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))
    begin, go_on = {draw() for _ in range(12)}, {draw() for _ in range(12)}
    own = token_counts.Automaton(begin, go_on)
    for _ in range(300):
        w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert own.count(w) == greedy(w, begin, go_on), (w, begin, go_on)
