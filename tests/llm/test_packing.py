"""Packing: coverage, bounds, mixture, and the closed form against the loop of deficits."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from matchloom.llm import packing
from matchloom.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(25))
def test_schedule_is_the_deficit_loop(seed):
    rng = random.Random(seed)
    queues = [rng.randint(500, 20_000) for _ in range(rng.randint(1, 9))]
    size = rng.choice([16, 64, 256])
    bounds = [0]
    for q in queues:
        bounds.append(bounds[-1] + q)
    plan = packing.Schedule(tuple(bounds), size)
    for w, served in enumerate(packing.roundrobin(queues, size)):
        assert [plan.served(j, w + 1) - plan.served(j, w) for j in range(len(queues))] == served
    for j, n in enumerate(queues):
        for _ in range(20):
            p = rng.randrange(n)
            w = plan.window_of(j, p)
            assert plan.served(j, w) <= p < plan.served(j, w + 1)


@pytest.mark.parametrize("seed", range(20))
def test_phases_are_deficit_loops_one_after_another(seed):
    """Unequal targets: within a token of each window until a queue is dry, its share then to the others; every token once."""
    rng = random.Random(seed)
    k, size = rng.randint(1, 7), rng.choice([64, 256])
    sizes = [rng.randint(1, 20_000) for _ in range(k)]
    weights = [rng.choice([0, 1, 2, 5, 9]) for _ in range(k)]
    if any(w * size < sum(weights) for w in weights if w):
        return
    phases = packing.phases_of(sizes, weights)
    assert [sum(p[j + 1] - p[j] for p in phases) for j in range(k)] == sizes and len(phases) <= k
    plan = packing.Phased(tuple(np.cumsum([0, *sizes]).tolist()), size, phases)
    assert plan.total == sum(sizes)
    for w in range(plan.windows):
        mine = [plan.served(j, w + 1) - plan.served(j, w) for j in range(k)]
        assert min(mine) >= 0 and sum(mine) == plan.upto(w + 1) - plan.upto(w)
        assert [plan.before(j, w) for j in range(k)] == [sum(mine[:j]) for j in range(k)]
        if sum(weights) and w < plan.windows - 1 and plan.upto(w + 1) <= phases[0][-1]:
            assert all(abs(n - size * x / sum(weights)) <= 2 for n, x in zip(mine, weights)), (mine, weights)
    for j, n in enumerate(sizes):
        for _ in range(20):
            p = rng.randrange(n)
            w = plan.window_of(j, p)
            assert plan.served(j, w) <= p < plan.served(j, w + 1)
    start = 0
    for p in phases:
        if start % size == 0 and p[-1] % size == 0:
            served = packing.roundrobin([b - a for a, b in zip(p, p[1:])], size)
            assert [[plan.served(j, w + 1) - plan.served(j, w) for j in range(k)] for w in range(start // size, (start + p[-1]) // size)] == served
        start += p[-1]


def pieces_of(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, start string, sequence_id int")
    return packing.pack(df, PATH, **settings)


def check(rows, got, size):
    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    want = sorted((d, lib.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, *_ in rows if d is not None)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        raw = np.frombuffer(r["ids"], "<u4")
        assert len(raw) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
    for d, ids in want:
        parts = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]) for r in by_doc[d])
        copies = sum(x == d for x, _ in want)
        joined = [i for _, p, _ in parts for i in p]
        assert len(joined) == copies * len(ids) and {n for _, _, n in parts} == {len(ids)}
        if copies == 1:
            assert joined == ids and [s for s, _, _ in parts] == list(np.cumsum([0] + [len(p) for _, p, _ in parts])[:-1])
    lengths = []
    for _, spans in sorted(by_sequence.items()):
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        lengths.append(at)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(n == size or n & (n - 1) == 0 for n in lengths) and max(lengths) <= size
    return by_sequence


def test_every_token_once_and_mixture_in_every_window(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 5 + [f"s{k}" for k in range(6)] + [f"rare{i}"] * 1)
        rows.append((i, " ".join(rng.choice(["alpha", "beta", "Gamma.", "delta,", "x1", "ñu"]) for _ in range(rng.randint(0, 60))), source, "clash", 0))
    rows += [(2000, None, None, "", 0), (2001, "", None, "", 0), (2002, "long " * 60_000, "s1", "", 0), (2003, "same", "s2", "", 0), (2003, "same", "s2", "", 0)]
    got = pieces_of(spark, rows, size=256, chunk_tokens=4096, least_share=4).collect()
    check(rows, got, 256)
    tokens = {}
    for r in got:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["length"]
    total, last = sum(tokens.values()), sum(tokens.values()) // 256 - 1
    for name in ("hot", "s1"):
        by = {}
        for r in got:
            if r["source"] == name:
                by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + r["length"]
        owed = 256 * tokens[name] / total
        assert all(abs(by.get(w, 0) - owed) <= 2 for w in range(last)), name


@pytest.mark.parametrize("hot", [0, 500])
def test_every_small_source_keeps_its_share(spark, hot):
    """65 sources below the least share, beside a source of a third or alone: none strays from its share by more than a few quanta."""
    least, size = 8, 512
    rows = [(i, "alpha beta Gamma. " * 15, "hot", "", 0) for i in range(hot)]
    rows += [(1000 + 20 * k + i, "alpha beta Gamma. " * 15, f"s{k}", "", 0) for k in range(65) for i in range(1 if k < 64 and k else 12)]
    rows += [(5000 + k, "one long document " * 225, f"s{k}", "", 0) for k in range(1, 64)]
    rows += [(9000, "of no source", None, "", 0), (9001, "tiny", "", "", 0), (9002, "tiny", "tiny", "", 0)]
    got = pieces_of(spark, rows, size=size, chunk_tokens=4096, least_share=least).collect()
    check(rows, got, size)
    tokens, by = {}, {}
    for r in got:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["length"]
        by[r["source"], r["sequence_id"]] = by.get((r["source"], r["sequence_id"]), 0) + r["length"]
    total = sum(tokens.values())
    small = [x for x, n in tokens.items() if n * size < total * least]
    assert len(small) >= 67
    for name in small:
        served = 0
        for w in range(total // size - 1):
            served += by.get((name, w), 0)
            assert abs(served - tokens[name] * size * (w + 1) / total) <= 4 * least + 2, (name, w)
    assert len(got) < 2 * len(rows) + total / least + 20 * total / size


def test_unequal_targets(spark):
    """Half of every window from a tenth of the corpus until that is packed; sources without a target share the rest."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma.", "x1"]) for _ in range(rng.randint(0, 40))), rng.choice(["big"] * 6 + ["good", "other", None] + [f"rare{i}"]), "", 0) for i in range(700)]
    size, targets = 256, {"good": 0.5, None: 0.1, "absent": 0.05}
    got = pieces_of(spark, rows, size=size, chunk_tokens=2048, least_share=4, targets=targets, chunk_rows=16).collect()
    check(rows, got, size)
    by, tokens = {}, {}
    for r in got:
        by[r["source"], r["sequence_id"]] = by.get((r["source"], r["sequence_id"]), 0) + r["length"]
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["length"]
    weight = 0.5 + 0.1 + 0.35  # what is absent takes part in nothing
    full = int(min(tokens["good"] / (0.5 / weight), tokens[None] / (0.1 / weight)) // size) - 1
    assert full > 5
    for w in range(full):
        assert abs(by["good", w] - size * 0.5 / weight) <= 2 and abs(by[None, w] - size * 0.1 / weight) <= 2
    rest = sum(n for x, n in tokens.items() if x not in targets)
    served = [sum(n for (x, v), n in by.items() if x == "big" and v <= w) for w in range(full)]
    assert all(abs(n - tokens["big"] / rest * size * (w + 1) * 0.35 / weight) <= 100 for w, n in enumerate(served))
    for bad in ({"good": 0.7, "big": 0.4}, {"good": 0.001}):
        with pytest.raises(ValueError):
            pieces_of(spark, rows, size=size, targets=bad)
    last = pieces_of(spark, rows, size=size, targets={"good": 1.0}).collect()
    check(rows, last, size)
    assert {r["source"] for r in last if r["sequence_id"] < tokens["good"] // size} == {"good"}


def test_null_and_repeated_ids_are_many_tasks(spark):
    rows = [(None, f"text number {i}", "a", "", 0) for i in range(900)] + [(7, f"other text {i}", "a", "", 0) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, hash string, chunk int")
    got = packing.pack(df, PATH, size=256, chunk_rows=64)
    assert got.agg({"length": "sum"}).first()[0] == sum(r["n_tokens"] for r in packing.encoded(df, PATH).collect())
    hashes = packing.encoded(df, PATH).selectExpr("pmod(xxhash64(doc_id, ids), 28) AS c").groupBy("c").count().collect()
    assert len(hashes) == 28 and max(r["count"] for r in hashes) < 130


def test_chunks_keep_all_rows(spark):
    rows = [(i, f"text number {i} " * (i % 9), f"s{i % 3}", "", 0) for i in range(200)]
    for chunk in (64, 1 << 20):
        check(rows, pieces_of(spark, rows, size=128, chunk_tokens=chunk).collect(), 128)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_rows_and_none(spark, n):
    rows = [(i, "tiny text", "a", "", 0) for i in range(n)]
    check(rows, pieces_of(spark, rows).collect(), 4096)
    assert pieces_of(spark, []).collect() == []


def test_without_ids(spark):
    got = pieces_of(spark, [(1, "a b", "s", "", 0)], with_ids=False)
    assert "ids" not in got.columns and got.count() >= 1
