"""SimHash groups against all pairs, and the exact way for crowded blocks."""

from __future__ import annotations

import random

import pytest
from xxhash import xxh64_intdigest

from matchloom.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def brute_components(prints):
    """``{doc_id: least reachable}`` by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if ((a ^ prints[j][1]) & (1 << 64) - 1).bit_count() <= 2:
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(prints):
        ids = [prints[j][0] for j in range(len(prints)) if find(j) == find(i) and prints[j][0] is not None]
        out[i] = min(ids, default=None)
    return out


def test_fingerprints_match_brute_force():
    rng = random.Random(3)
    texts = [None, "", "  \n", "one", "One two", "a b c", "Ünïcode Wörter hier und da", "x " * 5000]
    texts += [" ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    assert [simhash.simhash64(t) for t in texts] == [brute_print(t) for t in texts]


def test_xxhash_of_spark_agrees(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] & (1 << 64) - 1 == xxh64_intdigest(b"a b c", 42)


def prints_near(rng, n, crowd):
    out, base = [], rng.getrandbits(64)
    for i in range(n):
        fp = base if i < crowd else rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            fp ^= 1 << rng.randrange(64)
        out.append((i * 7 % 1009, fp - (1 << 64) if fp >> 63 else fp))
    return out


@pytest.mark.parametrize("heavy", [2, 48])
def test_components_match_all_pairs(spark, heavy, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (heavy,))
    prints = prints_near(random.Random(heavy), 220, 90)
    df = spark.createDataFrame(prints, "doc_id long, fp long")
    found = {r["fp"]: r["component_id"] for r in simhash.components(df).collect()}
    brute = brute_components(prints)
    assert {i: found[fp] for i, (_, fp) in enumerate(prints)} == brute


def test_whole_operator(spark):
    text = " ".join(f"word{i}" for i in range(300))
    near = text + " tail"
    rows = [(5, text), (3, text), (3, text), (9, near), (8, None), (7, ""), (2, "completely other words are here now"), (None, " "), (1, "x " * 200_000)]
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [(d, brute_print(t)) for d, t in rows]
    brute = brute_components(prints)
    want = sorted(((d, f"{fp & (1 << 64) - 1:016x}", brute[i]) for i, (d, fp) in enumerate(prints)), key=str)
    assert got == want
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).collect() == []


def test_deduplicate_keeps_one_row_of_each_component(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(4, text, "a"), (2, text, "b"), (2, text, "b"), (9, "some other text of its own kind", "c"), (None, None, None), (11, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [2, 9, 11]
    assert simhash.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_deduplicate_with_repeated_and_null_ids(spark, seed):
    """Unlike texts under one id, copies under many, equal rows and clashing columns: every component keeps its first row, once."""
    rng = random.Random(seed)
    base = [" ".join(f"t{k}w{i}" for i in range(rng.randint(1, 60))) for k in range(12)] + [None, "", " \n"]
    rows = [(rng.choice([None, 1, 2, 3, 5, 8, 2**60, -(2**62)]), rng.choice(base), rng.choice(["x", None]), 0.5, rng.randint(0, 1)) for _ in range(90)]
    rows += [(5, "A " + base[0], "x", 0.5, 1), (5, "B " + base[1], "x", 0.5, 1), (3, "B " + base[1], "x", 0.5, 1)] + [rows[0]] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, __fp double, rank int").repartition(5)
    kept = [tuple(r) for r in simhash.deduplicate(df).collect()]
    prints = [brute_print(r[1]) for r in rows]
    root = brute_components(list(enumerate(prints)))
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(root[i], []).append(r)
    assert len(kept) == len(members)
    for group in members.values():
        least = min((r[0] is None, r[0] or 0) for r in group)
        mine = [r for r in kept if r in group]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least
