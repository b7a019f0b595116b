"""One-permutation MinHash against true Jaccard similarity and a Python version of its densification."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from matchloom.llm import minhash


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def texts_of(rng, n, words):
    return [" ".join(f"w{rng.randrange(4000)}" for _ in range(words)) for _ in range(n)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, bits string")
    return minhash.fingerprint_edits(df)


def test_edits_and_neighbours(spark):
    rng = random.Random(1)
    texts = texts_of(rng, 30, 60) + texts_of(rng, 20, 900) + ["", "   ", None, "one", "one two three four", "é日本 ñ x\ty\nz"]
    rows = [(i * 3, t, "x", "y") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in run(spark, rows).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    errors = []
    for i, (d, t, _, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        r = got[d]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((r["near_edited"], edited), (r["near_next"], after)):
            assert 0 <= value <= 1
            if len(t.split()) > 40 and len(other.split()) > 40:
                errors.append(abs(value - jaccard(t, other)))
        assert len(r["fingerprint"]) in (0, minhash.BINS)
    assert sum(errors) / len(errors) < 0.04 and max(errors) < 0.2


def test_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([i, i * 1000]), t, "", "") for i, t in enumerate(texts_of(rng, 80, 12))]
    base = sorted(map(tuple, run(spark, rows).collect()))
    monkeypatch.setattr(minhash.with_next, "__defaults__", ("doc_id", "text", 7))
    assert sorted(map(tuple, run(spark, rows).collect())) == base


def test_equal_texts_ties_nulls_and_empty_tables(spark):
    rows = [(1, "a b c d e f g", "", ""), (1, "a b c d e f g", "", ""), (None, "a b c d e f g", "", ""), (2, None, "", ""), (3, "", "", ""), (4, " ".join(["z"] * 50_000), "", "")]
    got = run(spark, rows).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(by[13]) == 1 and by[0] == {""}
    assert run(spark, rows).where("doc_id = 3").first()["near_next"] == 1.0  # empty beside empty
    assert run(spark, rows[:1]).first()["near_next"] == 1.0  # alone, it is its own next
    assert run(spark, [(None, "q w e r t y", "", ""), (None, "a", "", "")]).count() == 2
    df = spark.createDataFrame([], "doc_id long, text string, extra string, bits string")
    assert minhash.fingerprint_edits(df).collect() == []


def test_densified_bins_borrow_alike(spark):
    """Bins that nothing fell into agree between equal sets and repeat the values of filled bins."""
    df = spark.createDataFrame([("a b c d e f",), ("a b c d e f",), ("q r s t u v",)], "text string")
    bits = [r["b"] for r in minhash.fingerprint_bits(df, "text", "b").collect()]
    assert bits[0] == bits[1] and len(bits[0]) == minhash.BINS and len(set(bits[0])) <= 2
    like = df.crossJoin(df.limit(1).select(F.lit(1))).limit(1)
    assert like.count() == 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*parts):
    """Spark's xxhash64 of strings and ints: each seeds the next."""
    h = 42
    for p in parts:
        h = xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(4, "little"), h)
    return signed(h)


def plain_fingerprint(text):
    """One-permutation MinHash with optimal densification, bin by bin."""
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return ""
    filled = [None] * 256
    for i in range(max(1, len(words) - 4)):
        h = chained(*words[i : i + 5])
        at, value = (h >> 56) + 128, h & (1 << 56) - 1
        if value != (1 << 56) - 1 and (filled[at] is None or value < filled[at]):
            filled[at] = value
    bins = list(filled)
    for i in range(256):
        for attempt in range(1, 17):
            if bins[i] is None:
                bins[i] = filled[chained(i, attempt) % 256]
        if bins[i] is None:
            bins[i] = min((chained(i, j, 17), v) for j, v in enumerate(filled) if v is not None)[1]
    return "".join(f"{v & 15:x}" for v in bins)


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b)) / 256
    return min(1.0, max(0.0, (same - 1 / 16) / (1 - 1 / 16)))


def test_digits_and_bias_correction_against_plain_python(spark):
    rng = random.Random(6)
    texts = texts_of(rng, 6, 3) + texts_of(rng, 6, 40) + texts_of(rng, 4, 700) + ["one", None, " ", "é日本 ñ x\ty\nz"]
    texts += [texts[7] + " tail", texts[13][: len(texts[13]) // 2]]
    rows = [(i, t, "", "") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in run(spark, rows).collect()}
    for i, t in enumerate(texts):
        after = texts[i - 1] or ""
        n = len(t or "") // 3
        edited = (t or "")[: len(t or "") - n] + after[:n]
        want = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == want[:2]
        assert abs(got[i]["near_edited"] - plain_likeness(want[0], want[1])) < 1e-12 and abs(got[i]["near_next"] - plain_likeness(want[0], want[2])) < 1e-12


def test_sparse_wide_repeated_and_null_ids(spark):
    """Chunks stay even, and neighbours right, whatever 64-bit numbers the ids are."""
    ids = [*range(60), 2**60, 2**63 - 1, -(2**63), 9 * 10**18, -9 * 10**18, *[7] * 20, *[None] * 20]
    rng = random.Random(8)
    rows = [(d, f"text {i} " + " ".join(f"w{rng.randrange(99)}" for _ in range(9)), "", "") for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, chunk string")
    placed = minhash.with_next(df, chunk_rows=8).collect()
    sizes = {}
    for r in placed:
        sizes[r["chunk"]] = sizes.get(r["chunk"], 0) + 1
    assert len(sizes) > 6 and max(sizes.values()) <= 24
    own = [r for r in placed if r["extra"] == 0]
    assert len(own) == len(rows)
    of = {r["text"]: r for r in own}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), chained(r[1])))
    for i, r in enumerate(order):
        assert of[r[1]]["next_text"] == order[(i + 1) % len(order)][1]


def test_main_path_is_native(spark):
    plan = run(spark, [(1, "a b", "", ""), (2, "c", "", "")])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))
