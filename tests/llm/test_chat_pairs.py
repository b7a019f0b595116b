"""Preference pairs against a plain rendering."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from matchloom.llm import chat_pairs


def render(turn):
    return f"<|{turn[1] or ''}|>\n{turn[2] or ''}<|end|>\n"


def brute(rows):
    sides = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            sides.setdefault(conv // 2, ({}, {}))[conv % 2][(turn, role, text)] = 1
    return paired(sides)


def paired(sides):
    key = lambda t: tuple((x is not None, x) for x in t)
    out = {}
    for pair, (c, r) in sides.items():
        c, r = sorted(c, key=key), sorted(r, key=key)
        n = 0
        while n < min(len(c), len(r)) and c[n][1:] == r[n][1:]:
            n += 1

        def completion(turns):
            text, spans = "", []
            for t in turns:
                if t[1] == "assistant":
                    begin = len(text) + len(f"<|{t[1]}|>\n")
                    spans.append(f"{begin}:{len(text) + len(render(t)) - 1}")
                text += render(t)
            return text, ",".join(spans)

        out[pair] = (n, "".join(map(render, c[:n])), *completion(c[n:]), *completion(r[n:]))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    return chat_pairs.format_preferences(df, F.shiftright("conv_id", 1), F.pmod("conv_id", F.lit(2)) == 0)


def test_pairs_match_a_plain_rendering(spark):
    rng = random.Random(6)
    rows = []
    for pair in range(60):
        shared = [(t, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "", None, "längerer Text\nzwei"])) for t in range(rng.randint(0, 5))]
        for conv in (2 * pair, 2 * pair + 1):
            if rng.random() < 0.1:
                continue
            own = shared + [(len(shared) + k, rng.choice(["user", "assistant"]), f"t{rng.randrange(3)}") for k in range(rng.randint(0, 3))]
            rows += [(conv, *t) for t in own]
    rows += rows[:9]  # repeated turns
    rows += [(500, 0, "user", "x" * 200_000), (501, 0, "user", "x" * 200_000), (501, 1, "assistant", "end"), (None, 0, "user", "lost"), (700, None, "assistant", "no number")]
    rng.shuffle(rows)
    got = {r["pair_id"]: (r["n_prompt_turns"], r["prompt"], r["chosen"], r["chosen_mask"], r["rejected"], r["rejected_mask"]) for r in run(spark, rows).collect()}
    assert got == brute(rows)
    for n, prompt, chosen, mask, _, _ in got.values():
        for span in filter(None, mask.split(",")):
            a, b = map(int, span.split(":"))
            assert chosen[a:b].endswith("<|end|>") and chosen[:a].endswith("|>\n")


def exchanged(rows):
    """Every conversation up to its last reply, and with its partner's last reply instead."""
    talks = {}
    for conv, *turn in rows:
        if conv is not None:
            talks.setdefault(conv, set()).add(tuple(turn))
    key = lambda x: (x is not None, x)
    last = {c: max((t for t in turns if t[1] == "assistant"), key=lambda t: (key(t[0]), key(t[2])), default=None) for c, turns in talks.items()}
    sides = {}
    for c, turns in talks.items():
        end, other = last[c], last.get(c ^ 1)
        kept = [t for t in turns if end is None or t[0] is None or end[0] is None or t[0] <= end[0]]
        final = [t for t in kept if end is not None and t[0] == end[0] and t[1] == "assistant"]
        rejected = [t for t in kept if t not in final] + ([(end[0], "assistant", other[2] or "")] if final and other is not None else [])
        sides[c] = dict.fromkeys(kept), dict.fromkeys(rejected)
    return paired(sides)


def test_exchanged_replies_share_their_prompts(spark):
    rng = random.Random(7)
    ids = [*range(40), 2**54, 2**54 + 1, 2**54 + 2, 2**63 - 1, -(2**63), -(2**63) + 1, -7]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None]), rng.choice(["hi", "", None, f"text {c} {t}"])) for c in ids for t in range(rng.randint(1, 7))]
    rows += rows[:5] + [(None, 0, "user", "lost"), (None, 1, "assistant", "lost"), (3, None, "assistant", "no number"), (100, None, "assistant", "only"), (101, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id long, turn long, role string, text string, last string, is_chosen boolean")
    made = chat_pairs.format_preferences(chat_pairs.exchanged_replies(df), F.col("pair_id"), F.col("is_chosen"))
    got = {r["pair_id"]: (r["n_prompt_turns"], r["prompt"], r["chosen"], r["chosen_mask"], r["rejected"], r["rejected_mask"]) for r in made.collect()}
    assert got == exchanged(rows)
    assert sum(bool(x[1]) for x in got.values()) > len(got) / 2
    assert chat_pairs.exchanged_replies(df.limit(0)).count() == 0


def test_empty_and_native(spark):
    df = run(spark, [(0, 0, "user", "a")])
    assert run(spark, []).collect() == []
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))
