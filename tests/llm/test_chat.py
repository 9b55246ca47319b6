"""Snapshot collapse against brute force."""

import random

from sablefin.llm import chat


def brute(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None:
            conversations.setdefault(conv, []).append((turn, role, text))
    key = lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or "")
    whole = {c: tuple(sorted(ts, key=key)) for c, ts in conversations.items()}
    proper = set()
    for ts in whole.values():
        for turn in {t[0] for t in ts}:
            part = tuple(t for t in ts if t[0] <= turn)
            if len(part) < len(ts):
                proper.add(part)
    kept = {}
    for c, ts in whole.items():
        if ts not in proper:
            kept.setdefault(ts, []).append(c)
    out = set()
    for ts, cs in kept.items():
        text = "".join(f"<|im_start|>{r or 'unknown' if r is None else r}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for _, r, t in ts)
        out.add((min(cs), len(ts), len(cs), text))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, n string, copies int")
    return {tuple(r) for r in chat.collapse_and_render(df).collect()}


def test_snapshots(spark):
    rng = random.Random(1)
    rows, number = [], 0
    for _ in range(30):
        turns = [(i, ["user", "assistant"][i % 2], rng.choice(["hi", "yes", "no", "tell me"])) for i in range(rng.randrange(1, 6))]
        for n in range(1, len(turns) + 1):
            if rng.random() < 0.7:
                rows += [(number, *t) for t in turns[:n]]
                number += 1
    assert found(spark, rows) == brute(rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 3)
    long = [(1, i, "user", f"turn {i}") for i in range(20)]
    part = [(2, i, "user", f"turn {i}") for i in range(13)]
    copy = [(3, i, "user", f"turn {i}") for i in range(20)]
    other = [(4, 0, "user", "turn 0"), (4, 1, "user", "another")]
    nulls = [(5, 0, None, None), (6, 0, None, ""), (7, 0, "", None), (None, 0, "user", "x"), (8, None, "user", "x"), (20, 0, "user", None), (21, 0, "user", "\x00"), (22, 0, "\x00", None), (23, 0, "user", "\x02"), (24, 0, "user", "long " * 100_000), (9, -5, "user", "<|im_end|>"), (9, 4000, "user", "far")]
    ties = [(10, 0, "a", "x"), (10, 0, "a", "x"), (11, 0, "a", "x"), (12, 0, "b", "y"), (12, 0, "a", "x"), (13, 0, "a", "x"), (13, 0, "b", "y"), (13, 1, "a", "z")]
    rows = [*long, *part, *copy, *other, *nulls, *ties]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()
