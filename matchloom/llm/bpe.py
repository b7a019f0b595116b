"""Byte-level BPE by a pair occurrence index.

A partition's texts are split into pieces by the vocabulary's pattern, and each distinct piece that
the worker has not met is laid out once as a run of byte symbols. An index maps every adjacent pair of
symbols that has a merge to all its positions in the partition. Active merges are applied in
ascending rank: a merge visits the positions of its pair from left to right, joins them, and
enters the new neighbouring pairs into the index. As a merge's own token must exist before
a pair can contain it, new pairs always rank higher, and one pass over the ranks settles
all pieces at once.

The index spans the new pieces of ``ROWS`` rows of a partition at a time, which bounds a worker's memory; as no pair reaches across pieces, the result is the same.

Edge cases: null and empty texts have no tokens; the added tokens' strings in a text are their ids, as in
the tokenizers library; lone surrogates cannot occur in Parquet strings. Ids outside the
vocabulary raise. Repeated rows are encoded alike. A very long text is encoded whole, and a very long piece (no white space for megabytes) in packed arrays of about
30 bytes a byte. Extra columns are not read, whatever their names. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from matchloom.llm.common import Numbers, map_batches, slices

#: Pieces after which a worker's cache is emptied; rows whose new pieces are indexed together; symbols beyond which they are held in packed arrays.
PIECES, ROWS, MANY = 400_000, 512, 1 << 20

#: How byte-level vocabularies split text. White space is Unicode White_Space.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern(space: str, letter: str, number: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


PATTERN = _pattern(_SPACE, r"\p{L}", r"\p{N}")
#: The same split for texts up to U+017F, where the classes are short lists.
LATIN_PATTERN = _pattern(r"\t-\r\x20\x85\xa0", "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be")
_BEYOND_LATIN = re.compile("[^\x00-\u017f]").search


def byte_symbols() -> dict[str, int]:
    """The printable stand-in character of every byte, as these vocabularies write them."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:  # a vocabulary, not an input table
            held = json.load(file)
        model, symbols = held["model"], byte_symbols()
        vocab = model["vocab"]
        self.added = {x["content"]: x["id"] for x in held.get("added_tokens", [])}
        raw = {t: bytes(symbols[c] for c in t) if all(c in symbols for c in t) else t.encode() for t in vocab}
        self.bytes_of: dict[int, bytes] = {i: raw[t] for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.first = [vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.pair_at: list[tuple[int, int]] = []
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (vocab[left], vocab[right])
            self.rank.setdefault(pair, len(self.made))
            self.made.append(vocab[left + right])
            self.pair_at.append(pair)
        self.split_any, self.split_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.by_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = Numbers()

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """The ids of every piece, little-endian unsigned 32-bit, by the pair occurrence index."""
        first, rank = self.first, self.rank
        many = sum(map(len, pieces)) > MANY
        numbers = (lambda *x: array("i", *x)) if many else list
        symbol = numbers()
        for piece in pieces:
            symbol.extend(map(first.__getitem__, piece.encode()))
            symbol.append(-1)  # ends a piece: no pair contains it
        n = len(symbol)
        after = numbers(range(1, n + 1))
        before = numbers(range(-1, n - 1))
        index: dict[int, list[int] | array] = defaultdict(numbers)
        get = rank.get
        for at, pair in enumerate(pairwise(symbol)):
            if (r := get(pair)) is not None:
                index[r].append(at)
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right = self.pair_at[r]
            token = self.made[r]
            for at in np.sort(index.pop(r)).tolist() if many else sorted(index.pop(r)):
                if symbol[at] != left:
                    continue
                other = after[at]
                if symbol[other] != right:
                    continue
                symbol[at] = token
                symbol[other] = -2  # joined
                onward = after[other]
                after[at] = onward
                before[onward] = at
                if (x := get((token, symbol[onward]))) is not None:
                    if x not in index:
                        heapq.heappush(active, x)
                    index[x].append(at)
                prior = before[at]
                if prior >= 0 and (x := get((symbol[prior], token))) is not None:
                    if x not in index:
                        heapq.heappush(active, x)
                    index[x].append(prior)
        kept = np.array(symbol, dtype=np.int32)
        ends = np.flatnonzero(kept == -1)
        lasting = kept >= 0
        upto = np.cumsum(lasting)
        ids = kept[lasting].astype("<u4").tobytes()
        cuts = [0, *upto[ends].tolist()]
        return [ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        number = pieces.__getitem__
        numbers = [list(map(number, self._parts(t))) for t in texts]
        found = dict(zip(pieces.new, self.merge_all(pieces.new)))
        for text, i in self.added.items():
            if text in found:
                found[text] = np.array([i], dtype="<u4").tobytes()
        pieces.ids += map(found.__getitem__, pieces.new)
        pieces.new.clear()
        get = pieces.ids.__getitem__
        out = [b"".join(map(get, x)) for x in numbers]
        pieces.forget_beyond(PIECES)
        return out

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if _BEYOND_LATIN(text) else self.split_latin(text)

    def _parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.by_added is None or not self.by_added.search(text):
            return self.split(text)
        out: list[str] = []
        for i, section in enumerate(self.by_added.split(text)):
            out += [section] if i % 2 else self.split(section)
        return out

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_models: dict[str, ByteBPE] = {}


def model(path: str) -> ByteBPE:
    """One model and cache per worker process and vocabulary."""
    if path not in _models:
        _models[path] = ByteBPE(path)
    return _models[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for part in slices(batches, ROWS):
            found = own.encode_batch(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_tokens long, ids binary")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.decode(x or b"") for x in part.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(rows.select(rows[id_col].alias("doc_id"), rows[ids_col].alias("ids")), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` in one pass, without moving ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part in slices(batches, ROWS):
            found = own.encode_batch(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([sha(x) for x in found], pa.string()),
                 pa.array([sha(own.decode(x).encode("utf-8")) for x in found], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
