"""The ledger against a plain count, and policies and ablations against the ledger."""

from __future__ import annotations

import random
import re

from matchloom.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    covered = set()
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in grams.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def samples():
    rng = random.Random(5)
    words = ["alpha", "beta", "x", "ß", "日本", "the&&&", "a|b", "non breaking", "end."]
    out = [None, "", " \n\t", "word", "a b\na b\n\na b", "x " * 60_000]
    for _ in range(120):
        t = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        out.append(rng.choice([" ", "\n", "  ", "\t", "\x0b"]).join(t) * rng.randint(1, 3))
    return out


def test_measurements_match_a_plain_count():
    for t in samples():
        assert quality.measure(t)[:5] == brute(t), t


def test_windows_of_long_texts_are_counted_alike(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(n)).split() for n in (1, 8, 9, 40, 400)] + [list(range(30)) * 2, ["x"] * 50]
    plain = [quality.repeated_words(t) for t in texts]
    monkeypatch.setattr(quality, "LONG", 0)
    assert [quality.repeated_words(t) for t in texts] == plain
    assert [quality._repeated_in_arrays(list(t), 5) for t in texts if len(t) > 8] == [quality.repeated_words(t, 5) for t in texts if len(t) > 8]


def test_ledger_policies_and_ablations(spark):
    texts = samples() + ["good words in a row " * 1 + " ".join(f"w{i}" for i in range(60))]
    df = spark.createDataFrame([(i, t, 1, "x", "m", 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string, measured string, failed_bits int")
    rows = quality.ledger(df)
    judged = {r["doc_id"]: r for r in quality.apply_policy(rows).collect()}
    for i, t in enumerate(texts):
        n_words, _, _, _, n_repeat = brute(t)
        assert judged[i]["base_failed"] == (n_words < 20 or 100 * n_repeat > 30 * n_words)
        assert judged[i]["kept"] == quality.verdict(t)
        assert not (judged[i]["kept"] and judged[i]["base_failed"])
    for version, names in quality.POLICIES.items():
        mask = quality.mask_of(version)
        bits = [r["failed_bits"] & mask for r in judged.values()]
        for r in quality.ablations(rows, version).collect():
            bit = quality.BITS[r["rule"]]
            assert r["rule"] in names
            assert (r["failed"], r["failed_only"], r["kept"]) == (sum(b & bit > 0 for b in bits), bits.count(bit), bits.count(0))
            assert r["kept_without"] == sum(b & ~bit == 0 for b in bits)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in judged.items() if r["kept"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.ledger(df).count() == 0 and quality.keep_good(df).count() == 0
    assert all(r["kept"] == 0 for r in quality.ablations(quality.ledger(df)).collect())
