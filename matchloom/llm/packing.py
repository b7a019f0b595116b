"""Mixture-controlled packing by deficit round-robin over source queues.

Documents wait in one queue per source. Window after window each queue is credited its
share of the window (its quantum: the source's target share of tokens), is served the whole tokens
of its credit, cutting a document where the credit ends, and carries the rest as its
deficit into the next window. Queues are visited in a fixed order. Every window so holds every
source within one token of its target share. Where the targets are the corpus's own shares (the default), all
queues run empty together. With other ``targets`` one queue runs dry first: from there on its share goes to the others in proportion to theirs, deficits
carried, and so on until all are packed, so that every token is placed once. Sources without a target share what the targets leave, by their
tokens; where that is nothing, they follow when the others are packed.

The deficits need no sequential loop. Between two queues running dry, with ``A_j`` the tokens served of the first ``j`` queues, ``T``
of all, and ``x`` the tokens packed up to the end of a window, the cumulative service of
queue ``j`` is ``floor(A_j x / T) - floor(A_{j-1} x / T)``, and its deficit is what this lacks of
``T_j x / T``. So any partition can continue from the deficits its predecessors leave, knowing
only prefix sums: of tokens by queue and chunk.

Windows are ``size`` tokens long, a sequence each. The last window is longer by the remainder
of ``T`` and is cut into a full sequence and sequences of powers of two, which need no padding.

A source with less than ``least_share`` tokens of a window would be served crumbs. It keeps a
queue of its own, served in larger quanta every few windows with its deficit carried: sources whose
tokens lie between the same powers of two form a class, and the tokens of a class are dealt to its sources by the same
closed form in rounds that give each of them ``least_share`` to twice as many tokens (the last round up to
four times; a source of fewer tokens is one quantum). A class of less than ``least_share`` tokens of a window is
dealt its part of the tokens of the next larger class (of the smallest queue, if there is none) in such
rounds too, as the closed form can owe a queue of less than one token a window a negative service. So a small source is at most a few
quanta ahead of or behind its share after any window. There are at most ``size / least_share`` queues and one
for each power of two, whatever the number of sources; bounds of small sources are columns, never on the driver.

Edge cases: a null text is empty and a document of one token, the end token; a null source is a
queue of its own; repeated rows are packed as often as they occur, and ids may be null or repeat over unlike texts, since rows are dealt by a hash of id and tokens;
a very long text is encoded whole and cut where credits end. Extra columns are not read, whatever their names. No rows: no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate, islice
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.bpe import byte_symbols
from matchloom.llm.common import Numbers, map_batches, slices
from matchloom.plans.durable import compact, materialize

SIZE, LEAST_SHARE, END = 4096, 64, 2
#: Words after which a worker's cache is emptied.
WORDS = 400_000
#: Chunks of a queue at most; their prefix sums are taken in one task a queue. Rows of the largest queue's chunks, as long as there are no more.
MOST_CHUNKS, CHUNK_ROWS = 1 << 17, 256
_encoders: dict[str, WordEncoder] = {}


class Merges:
    """The merges of a word vocabulary, applied to many words at once with array operations.

    Every step finds each word's lowest-ranked pair (the leftmost of equals) and joins it; words without
    one are done and leave the arrays. This is the order in which the tokenizers library
    merges each word by itself.
    """

    NONE = 1 << 30

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = sorted(byte_symbols().items(), key=lambda x: x[1])
        self.inner = np.array([vocab[c] for c, _ in letters], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c, _ in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint64)
        ranks = np.arange(len(keys), dtype=np.uint64)
        keys, first = np.unique(keys, return_index=True)
        self._hash(keys, ranks[first])

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Two tables of ``key << 16 | rank``: the second holds what collides in the first, by a multiplier that makes it fit."""
        draw = np.random.default_rng(1)
        while True:
            self.by = [np.uint64(x | 1) for x in draw.integers(1 << 62, 1 << 63, 2)]
            one, two = (np.full(1 << n, np.uint64(2**64 - 1)) for n in (20, 18))
            at = keys * self.by[0] >> np.uint64(44)
            _, first = np.unique(at, return_index=True)
            one[at[first]] = keys[first] << np.uint64(16) | ranks[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            at = keys[rest] * self.by[1] >> np.uint64(46)
            if len(np.unique(at)) == len(at):
                two[at] = keys[rest] << np.uint64(16) | ranks[rest]
                self.tables = one, two
                return

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 16 | right).astype(np.uint64)
        out = np.full(len(key), self.NONE, dtype=np.int64)
        for by, table, bits in zip(self.by, self.tables, (np.uint64(44), np.uint64(46))):
            found = table[key * by >> bits]
            hit = found >> np.uint64(16) == key
            out[hit] = (found[hit] & np.uint64(0xFFFF)).astype(np.int64)
        return out

    def encode(self, words: list[bytes], kind: np.dtype) -> list[bytes]:
        """Ids of non-empty words of bytes that are one piece each, packed as ``kind``."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbol, last = self.inner[raw], np.cumsum(lengths) - 1
        symbol[last] = self.final[raw[last]]
        word = np.repeat(np.arange(n), lengths)
        rank = np.full(len(symbol), self.NONE, dtype=np.int64)  # of the pair that begins here
        if len(symbol) > 1:
            rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
        rank[last] = self.NONE
        done_word, done_symbol = [], []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            alive = best < self.NONE
            here = np.repeat(best, sizes)
            if not alive.all():
                live = np.repeat(alive, sizes)
                done_word.append(word[~live])
                done_symbol.append(symbol[~live])
                symbol, word, rank, here = symbol[live], word[live], rank[live], here[live]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == here)
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            rank[at] = self.NONE
            onward = at[(at + 1 < len(word))]
            onward = onward[word[onward + 1] == word[onward]]
            rank[onward] = self.ranks(symbol[onward], symbol[onward + 1])
            prior = at[at > 0]
            prior = prior[word[prior - 1] == word[prior]] - 1
            rank[prior] = self.ranks(symbol[prior], symbol[prior + 1])
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        ids = symbol[order].astype(kind).tobytes()
        cuts = (np.cumsum(np.bincount(word, minlength=n)) * kind.itemsize).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]


class WordEncoder:
    """Token ids as the tokenizers library gives them, by way of a cache of words.

    Neither the normaliser nor the merges of this kind of vocabulary reach across white
    space, and it lower-cases, so a text's ids are those of its ASCII-lower-cased runs between ASCII
    white space, in order. A full stop or comma between a letter or digit and white space is
    a run of its own. Runs of plain Latin letters are merged here; the library encodes all others.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(self.tokenizer.to_str())["model"]
        most = max(self.tokenizer.get_vocab().values())
        self.kind = np.dtype("<u2" if most < 1 << 16 else "<u4")
        self.merges = Merges(model) if most < 1 << 16 and len(model["merges"]) < 1 << 16 and model["type"] == "BPE" and model["end_of_word_suffix"] else None
        self.index = Numbers()

    def learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of each of these words."""
        pieces, counts, other = [], [], []
        for w in new:
            if w.isalpha():
                pieces.append(w)
                counts.append(1)
            elif w.isascii() and b"'" not in w and b"<|" not in w:
                parts = _PIECES(w)
                pieces += parts
                counts.append(len(parts))
            elif _LATIN(t := w.decode("utf-8", "replace")):
                pieces.append(t.lower().encode())
                counts.append(1)
            else:
                counts.append(0)
                other.append(w)
        if self.merges is None:
            pieces, counts, other = [], [0] * len(new), new
        made = iter(self.merges.encode(pieces, self.kind)) if pieces else iter(())
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False) if other else []
        alone = (np.array(e.ids, dtype=self.kind).tobytes() for e in found)
        return [next(made) if n == 1 else b"".join(islice(made, n)) if n else next(alone) for n in counts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        number, ids = self.index.__getitem__, self.index.ids
        numbers = [list(map(number, _runs(t))) if t else [] for t in texts]
        ids += self.learn(self.index.new)
        self.index.new.clear()
        get = ids.__getitem__
        out = [b"".join(map(get, x)) for x in numbers]
        self.index.forget_beyond(WORDS)
        return out


#: How the vocabulary's pattern splits lower-cased ASCII without apostrophes.
_PIECES = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+").findall
#: Letters that normalising leaves as one letter, lower-cased by itself.
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0137\u0139-\u0148\u014a-\u017e]+").fullmatch
#: A stop or comma after anything but a letter or digit that normalising leaves as one character.
_JOINED = re.compile(r"[^0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f \t-\r][.,][ \n]")


def _runs(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace").lower()
    if not _JOINED.search(text):  # no stop or comma belongs to a longer run of symbols
        raw = raw.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n")
    return raw.split()


def encoder(path: str) -> WordEncoder:
    """One encoder and cache per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Free the encoders and caches of a worker process that goes on to other work."""
    _encoders.clear()


def encoded(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, n_tokens, ids``: little-endian ids, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(path)
        last = np.array([end], dtype=mine.kind).tobytes()
        for part in slices(batches, 1024):
            found = [x + last for x in mine.encode(part.column(2).to_pylist())]
            lengths = [len(x) // mine.kind.itemsize for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(lengths, pa.int64()), pa.array(found, pa.binary())],
                names=["doc_id", "source", "n_tokens", "ids"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[text_col].cast("string").alias("text"))
    return map_batches(compact(rows), run, "doc_id long, source string, n_tokens long, ids binary")


@dataclass(frozen=True)
class Schedule:
    """The queues' places in every window, from prefix sums alone."""

    bounds: tuple[int, ...]  # A_0 = 0, A_1, ..., T
    size: int

    @property
    def total(self) -> int:
        return self.bounds[-1]

    @property
    def windows(self) -> int:
        return max(1, self.total // self.size)

    def upto(self, window: int) -> int:
        """Tokens packed before this window."""
        return self.total if window >= self.windows else window * self.size

    def served(self, queue: int, window: int) -> int:
        """Tokens of a queue packed before this window."""
        x = self.upto(window)
        return self.bounds[queue + 1] * x // self.total - self.bounds[queue] * x // self.total

    def before(self, queue: int, window: int) -> int:
        """Where the queue's tokens begin in the window."""
        return self.bounds[queue] * self.upto(window + 1) // self.total - self.bounds[queue] * self.upto(window) // self.total

    def window_of(self, queue: int, position: int) -> int:
        """The window that holds a queue's token at this position."""
        own = self.bounds[queue + 1] - self.bounds[queue]
        w = min(self.windows - 1, position * self.total // own // self.size)
        while self.served(queue, w) > position:
            w -= 1
        while self.served(queue, w + 1) <= position:
            w += 1
        return w

    def tail(self) -> list[tuple[int, int]]:
        """``(start in the last window, length)`` of its sequences: full ones, then powers of two."""
        left, at, found = self.total - self.upto(self.windows - 1), 0, []
        while left:
            n = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            found.append((at, n))
            at, left = at + n, left - n
        return found

    def runs(self, queue: int, position: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """``(start in document, length, window, offset)`` of a document at a queue's position."""
        done, window = 0, self.window_of(queue, position)
        while done < length:
            begin, end = self.served(queue, window), self.served(queue, window + 1)
            take = min(length - done, end - (position + done))
            if take > 0:
                yield done, take, window, self.before(queue, window) + position + done - begin
                done += take
                window += 1
            else:  # the queue is served nothing here
                window = max(window + 1, self.window_of(queue, position + done))

    def pieces(self, queue: int, position: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """``(start in document, length, sequence, offset)`` of a document at a queue's position."""
        tail = None
        for done, take, window, offset in self.runs(queue, position, length):
            if window < self.windows - 1:
                yield done, take, window, offset
                continue
            tail = tail or self.tail()
            for i, (at, n) in enumerate(tail):
                lo, hi = max(at, offset), min(at + n, offset + take)
                if lo < hi:
                    yield done + lo - offset, hi - lo, window + i, lo - at

    def through(self, queue: int, levels: tuple[Schedule, ...], position: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """As ``pieces`` for a document of a small source: each level deals the tokens of the next, the last those of the queue."""
        if not levels:
            yield from self.pieces(queue, position, length)
            return
        for done, take, turn, offset in levels[0].runs(0, position, length):
            for start, n, sequence, at in self.through(queue, levels[1:], levels[0].upto(turn) + offset, take):
                yield done + start, n, sequence, at


@dataclass(frozen=True)
class Phased(Schedule):
    """A schedule of several phases, one after another: a queue runs dry at the end of each. ``bounds`` are those of all phases together."""

    phases: tuple[tuple[int, ...], ...] = ()

    def __post_init__(self) -> None:
        starts, bases = [0], [(0,) * len(self.bounds)]
        for p in self.phases:
            starts.append(starts[-1] + p[-1])
            bases.append(tuple(map(add, bases[-1], p)))
        object.__setattr__(self, "starts", starts[:-1])
        object.__setattr__(self, "bases", bases[:-1])

    def below(self, queue: int, x: int) -> int:
        """Tokens of the queues before this one among the first ``x`` packed."""
        p = bisect_right(self.starts, x) - 1
        own = self.phases[p]
        return self.bases[p][queue] + own[queue] * (x - self.starts[p]) // own[-1]

    def served(self, queue: int, window: int) -> int:
        x = self.upto(window)
        return self.below(queue + 1, x) - self.below(queue, x)

    def before(self, queue: int, window: int) -> int:
        return self.below(queue, self.upto(window + 1)) - self.below(queue, self.upto(window))

    def window_of(self, queue: int, position: int) -> int:
        p = bisect_right(self.bases, position, key=lambda b: b[queue + 1] - b[queue]) - 1
        own = self.phases[p]
        done = position - self.bases[p][queue + 1] + self.bases[p][queue]
        w = min(self.windows - 1, (self.starts[p] + done * own[-1] // (own[queue + 1] - own[queue])) // self.size)
        while self.served(queue, w) > position:
            w -= 1
        while self.served(queue, w + 1) <= position:
            w += 1
        return w


def phases_of(sizes: list[int], weights: list[int]) -> tuple[tuple[int, ...], ...]:
    """The bounds of every phase, from the queues' tokens and weights: each phase serves by weight until a queue is dry. Queues without weight come last, by their tokens."""
    left, found = list(sizes), []
    while any(left):
        active = [j for j, n in enumerate(left) if n and weights[j]]
        pull = weights if active else left
        active = active or [j for j, n in enumerate(left) if n]
        dry = min(active, key=lambda j: Fraction(left[j], pull[j]))
        give = [left[dry] * pull[j] // pull[dry] if j in active else 0 for j in range(len(left))]
        left = [n - g for n, g in zip(left, give)]
        found.append((0, *accumulate(give)))
    return tuple(found)


Places = list[tuple[int, tuple[Schedule, ...]]]


def arrange(large: list[int], classes: list[int], size: int, least_share: int) -> tuple[Schedule, Places]:
    """The schedule of the windows, and the queue and levels of every large source and then every class, from their tokens."""
    sizes = large + classes
    total = sum(sizes)
    least = -(-total * least_share // size)
    levels: list[tuple[Schedule, ...]] = [()] * len(sizes)
    big = [(n, [i]) for i, n in enumerate(large)]
    rest = sorted((n, [len(large) + i]) for i, n in enumerate(classes))
    while rest and rest[0][0] < least and len(rest) + len(big) > 1:
        n, few = rest.pop(0)
        other = rest if rest else big
        m, many = other.pop(other.index(min(other)))
        turn = -(-(n + m) * least_share // min(n, m))
        for i in few:
            levels[i] += (Schedule((0, n, n + m), turn),)
        for i in many:
            levels[i] += (Schedule((n, n + m, n + m), turn),)
        other.append((n + m, few + many))
        other.sort()
    bounds, places = [0], {}
    for q, (n, members) in enumerate(sorted(big + rest, key=lambda x: x[1])):
        bounds.append(bounds[-1] + n)
        places |= {i: (q, levels[i]) for i in members}
    return Schedule(tuple(bounds), size), [places[i] for i in range(len(sizes))]


def schedule(totals: DataFrame, size: int, least_share: int) -> tuple[Schedule | None, Places, dict[str | None, int], DataFrame | None]:
    """The schedule, its places, each large source's place, and the small sources' parts of the places of their classes.

    ``totals`` has ``source, n``. What comes to the driver: one sum, at most ``size / least_share`` sources, and
    a row for each power of two. Small sources are ``source, place, low, high, whole, turn``: the class's place, the source's bounds in its
    class, the class's tokens, and those of a round.
    """
    total = int(totals.agg(F.sum("n")).first()[0] or 0)
    if not total:
        return None, [], {}, None
    least = F.lit(-(-total * least_share // size))
    large = {r["source"]: int(r["n"]) for r in totals.where(F.col("n") >= least).collect()}
    names = sorted(large, key=lambda x: (x is not None, x or ""))
    small = totals.where(F.col("n") < least).withColumn("class", F.length(F.bin("n")) - 1)
    classes = [(r["class"], int(r["n"])) for r in small.groupBy("class").agg(F.sum("n").alias("n")).orderBy("class").collect()]
    plan, places = arrange([large[x] for x in names], [n for _, n in classes], size, least_share)
    queues = {x: i for i, x in enumerate(names)}
    if not classes:
        return plan, places, queues, None
    place, whole, turn = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, (power, n) in enumerate(classes):
        here = F.col("class") == power
        place, whole = F.when(here, len(names) + i).otherwise(place), F.when(here, F.lit(n).cast("long")).otherwise(whole)
        turn = F.when(here, F.lit(-(-n * least_share >> power)).cast("long")).otherwise(turn)
    high = F.sum("n").over(Window.partitionBy("class").orderBy(F.xxhash64("source", F.lit(2)), "source").rowsBetween(Window.unboundedPreceding, 0))
    small = small.select("source", place.alias("place"), (high - F.col("n")).alias("low"), high.alias("high"), whole.alias("whole"), turn.alias("turn"))
    return plan, places, queues, small


Targets = Mapping[str | None, float]


def targeted(totals: DataFrame, targets: Targets, size: int, least_share: int) -> tuple[Schedule | None, Places, dict[str | None, int], DataFrame | None]:
    """As ``schedule``, with a queue for every source that has a target, and one for all others together, which deals its tokens to them by theirs."""
    if min(targets.values(), default=1) * size < 1 or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("a target is a token of a window at least, and all together are 1 at most")
    named = F.lit(False)
    for name in targets:
        named = named | F.col("source").eqNullSafe(F.lit(name))
    own = {r["source"]: int(r["n"]) for r in totals.where(named).collect()}
    plan, places, queues, small = schedule(totals.where(~named), size, least_share)
    names = sorted(own, key=lambda x: (x is not None, x or ""))
    rest = 1 - sum(targets.values())
    weights = [round(targets[x] * 2**40) for x in names] + [round(rest * 2**40) if rest * size >= 1 or not names else 0]
    sizes = [own[x] for x in names] + [plan.total if plan else 0]
    if not sum(sizes):
        return None, [], {}, None
    if plan:
        turn = max(-(-size // least_share), size * weights[-1] // max(1, sum(weights)))  # about what they get of a window, and a token of each queue at least
        places = [(len(names), (*levels, Schedule((plan.bounds[q], plan.bounds[q + 1], plan.total), turn))) for q, levels in places]
    queues = queues | {x: len(places) + i for i, x in enumerate(names)}
    places = places + [(i, ()) for i in range(len(names))]
    return Phased((0, *accumulate(sizes)), size, phases_of(sizes, weights)), places, queues, small


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, least_share: int = LEAST_SHARE, chunk_tokens: int = 1 << 20, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: Targets | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source`` and, ``with_ids``, its ``ids``.

    ``targets`` gives sources their shares of every window; without it these are the shares of the corpus. Texts are encoded once. A queue's documents are spread over chunks of about
    ``chunk_tokens`` tokens or ``chunk_rows`` rows by hash of id and tokens, so that a source of any size is many tasks; a chunk's place
    in its queue is a prefix sum over chunk totals, and a document's place in its chunk a
    running sum within one task.
    """
    spark = docs.sparkSession
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids
    rows = materialize(encoded(docs, path, end, id_col, text_col, source_col).withColumn("hash", F.xxhash64("doc_id", "ids")), "packing-ids")
    totals = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")), "packing-sources")
    plan, places, queues, small = schedule(totals, size, least_share) if targets is None else targeted(totals, targets, size, least_share)
    if plan is None:
        return spark.createDataFrame([], columns)
    chunks = max(1, min(MOST_CHUNKS, max(plan.total // chunk_tokens, totals.agg(F.max("rows")).first()[0] // chunk_rows)))
    queue = F.lit(-1)
    for name, i in queues.items():
        queue = F.when(F.col("source").eqNullSafe(F.lit(name)), i).otherwise(queue)
    own = F.when(F.col("queue") >= 0, "").otherwise(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    rows = rows.withColumn("queue", queue).withColumns({"own": own, "chunk": F.pmod("hash", F.lit(chunks))})
    key = ["queue", "own", "chunk"]
    sums = rows.groupBy(*key).agg(F.sum("n_tokens").alias("n"))
    prefix = sums.select(*key, (F.sum("n").over(Window.partitionBy("queue", "own").orderBy("chunk")) - F.col("n")).alias("base"))
    bounds = ["place", "low", "high", "whole", "turn"]
    if small is None:
        prefix = prefix.select("*", F.col("queue").alias("place"), *(F.lit(None).cast("long").alias(x) for x in bounds[1:]))
    else:
        mine = small.select(F.lit(-1).alias("queue"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("own"), *bounds)
        prefix = prefix.join(mine, ["queue", "own"], "left").withColumn("place", F.coalesce("place", "queue"))
    order = Window.partitionBy(*key).orderBy("hash", "doc_id", "n_tokens", "ids", "source")
    placed = rows.withColumn("upto", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(prefix, key)
    placed = placed.select("doc_id", "source", "n_tokens", "ids", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("position"), *bounds)
    kind = encoder_kind(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for part in slices(batches):
            out: list[tuple] = []
            for doc, source, n, ids, position, q, low, high, whole, turn in zip(*(c.to_pylist() for c in part.columns)):
                own = np.frombuffer(ids, dtype=kind).astype("<u4").tobytes()
                queue, levels = places[q]
                if turn is not None:
                    levels = (Schedule((low, high, whole), turn), *levels)
                for start, length, sequence, offset in plan.through(queue, levels, position, n):
                    bit = own[4 * start : 4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(bit), n, sequence, offset, source, bit)[: 8 + with_ids])
            if out:
                types = ([pa.int64()] * 7 + [pa.string(), pa.binary()])[: 8 + with_ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), types)], names=[x.split()[0] for x in columns.split(", ")]
                )

    return map_batches(placed, cut, columns)


def encoder_kind(path: str) -> str:
    return encoder(path).kind.str


def roundrobin(queues: list[int], size: int) -> list[list[int]]:
    """The loop that ``Schedule`` states in closed form, window by window with explicit deficits: for tests.

    Returns each window's tokens by queue, the last window with the remainder.
    """
    total = sum(queues)
    windows = max(1, total // size)
    carried = [0] * (len(queues) + 1)  # what the queues up to this one are owed, in 1/total tokens
    out = []
    for w in range(windows):
        credit = size if w < windows - 1 else total - size * (windows - 1)
        upto, served = 0, []
        bound = 0
        for j, n in enumerate(queues):
            bound += n
            owed = carried[j + 1] + bound * credit
            whole, carried[j + 1] = divmod(owed, total)
            served.append(whole - upto)
            upto = whole
        out.append(served)
    return out
