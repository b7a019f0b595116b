"""Token counts by a linear longest-match automaton.

Counts the pieces of greedy longest-match-first segmentation (the word-piece rule) without making
the pieces. The vocabulary is a trie with two roots: one for word beginnings, one for
continuations. Every node has a failure link to the node that reads the same unread rest after the
longest token on its path is taken, and the number of tokens taken on that link.
Reading a word follows trie edges, and on a mismatch the failure link, adding its count: each
byte is read once, so a word takes time linear in its length.

From a byte-level BPE vocabulary: tokens with the word mark begin words, others continue them; as all
single bytes continue and the mark alone begins a word, every word has pieces. A word is a
run of ``[^\\x20\\x09-\\x0D]``. Null, empty and blank texts have no words and no tokens. Repeated rows are counted alike, and a very long text or word whole. Other columns are not
read, whatever their names. No rows: no rows.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm.bpe import byte_symbols
from matchloom.llm.common import Bounded, map_batches, slices, word_bytes

MARK = b"\x20"


class Automaton:
    """The trie of ``begin`` and ``continue`` tokens (bytes) with failure links and popped-token counts."""

    def __init__(self, beginning: set[bytes], continuing: set[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}, {}]
        token = [False, False]
        for root, words in ((0, beginning), (1, continuing)):
            for word in words:
                at = root
                for byte in word:
                    to = self.next[at].get(byte)
                    if to is None:
                        to = len(self.next)
                        self.next.append({})
                        token.append(False)
                        self.next[at][byte] = to
                    at = to
                token[at] = at > 1
        n = len(self.next)
        self.fail: list[int] = [-1] * n
        self.popped: list[int] = [0] * n
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for byte, v in self.next[u].items():
                if token[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, taken = self.fail[u], self.popped[u]
                    while z >= 0 and byte not in self.next[z]:
                        taken += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][byte], taken
                queue.append(v)

    def count(self, word: bytes) -> int | None:
        """Pieces of a word; None if greedy matching cannot cover it."""
        at, taken = 0, 0
        nxt, fail, popped = self.next, self.fail, self.popped
        for byte in word:
            while True:
                to = nxt[at].get(byte)
                if to is not None:
                    at = to
                    break
                if fail[at] < 0:
                    return None
                taken += popped[at]
                at = fail[at]
        while at > 1:
            if fail[at] < 0:
                return None
            taken += popped[at]
            at = fail[at]
        return taken if at == 1 or not word else None


def from_byte_vocabulary(path: str) -> Automaton:
    with open(path, encoding="utf-8") as file:  # a vocabulary, not an input table
        vocab = json.load(file)["model"]["vocab"]
    symbols = byte_symbols()
    tokens = {bytes(symbols[c] for c in t) for t in vocab if all(c in symbols for c in t)}
    return Automaton({t for t in tokens if t.startswith(MARK)}, tokens)


_automata: dict[str, tuple[Automaton, Bounded]] = {}


def automaton(path: str) -> tuple[Automaton, Bounded]:
    """One automaton and word cache per worker process and vocabulary."""
    if path not in _automata:
        _automata[path] = (from_byte_vocabulary(path), Bounded())
    return _automata[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = automaton(path)
        for part in slices(batches):
            split = [word_bytes(t) for t in part.column(1).to_pylist()]
            words = set().union(*split)
            new = [w for w in words if w not in cache]
            if not cache.room(len(new), sum(map(len, new))):
                new = list(words)
            cache.update((w, own.count(MARK + w)) for w in new)
            get = cache.__getitem__
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in split], pa.int64()), pa.array([sum(map(get, x)) for x in split], pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_words long, n_tokens long")
