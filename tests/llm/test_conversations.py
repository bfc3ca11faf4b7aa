"""Conversation repair against exhaustive search, and its levels against one stretch."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from strandjoin.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, pos long, fault string"
BLANK = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def brute_repair(rows):
    """Every choice of edits of one conversation's rows; the cheapest, then the least audit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    turns = [r[1] for r in rows if r[1] is not None]
    counts, seen, options = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, _, role, text in rows:
        end = text.rstrip(BLANK)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else None if end[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        more = 5 * (fault == "truncated")
        own = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            own.append((more, "K", [(role, text)]))
            own += [(1 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        options.append(own)
    added = [[]] + [[r] for r in ("user", "assistant")] + [["user", "assistant"], ["assistant", "user"]]
    inserted = [(5 * len(a), "I" * len(a), [(r, "") for r in a]) for a in added]
    best = None
    for picked in itertools.product(*[x for own in options for x in (inserted, own)], inserted):
        cost, audit = sum(p[0] for p in picked), "".join(p[1] for p in picked)
        lines = [line for p in picked for line in p[2]]
        if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    first = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def generated(seed, n):
    draw, rows = random.Random(seed), []
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire", "User"]
    texts = ["Yes.", "No!", "Why? \n", "cut", "", " \t", None, "é.", "two words"]
    for conv in [None, *range(n)]:
        for turn in range(draw.randint(1, 3)):
            at = draw.choice([turn] * 6 + [turn + 1, None])
            rows.append((conv, at, draw.choice(roles[: draw.choice([2, 5, 10])]), draw.choice(texts[: draw.choice([2, 9])])))
    return rows + [(n, 0, "user", None), (n, None, None, None), (n + 1, None, "system", "long " * 20000 + ".")]


def columns(row):
    return tuple(row[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def test_repair_equals_exhaustive_search(spark):
    rows = generated(7, 50)
    table = spark.createDataFrame([(*r, 1, "f") for r in rows], SCHEMA)
    found = conversations.repair_conversations(table, conversations.damage(table)).collect()
    damaged = brute_damage(rows)
    expected = {c: brute_repair([r for r in damaged if r[0] == c]) for c in {r[0] for r in rows}}
    assert {r["conv_id"]: columns(r) for r in found} == expected and len(found) == len(expected)


def test_stretches_and_levels_do_not_change_the_repair(spark):
    draw, rows = random.Random(3), []
    for conv, n in ((1, 700), (2, 300), (3, 5), (None, 40), (5, 257), (6, 256)):
        rows += [(conv, t, draw.choice(["user", "assistant", "system", "x"]), draw.choice(["a.", "b", f"{t}.", f"{t}"]), 1, "f") for t in range(n)]
    table = spark.createDataFrame(rows, SCHEMA)
    get = lambda **sizes: sorted(map(repr, conversations.repair_conversations(table, table, **sizes).collect()))
    whole = get(segment_bits=10)
    assert get() == whole and get(segment_bits=2, fan_bits=2) == whole


def test_repaired_conversations_have_the_form(spark):
    rows = [(c, t, r, f"{t}.", 1, "f") for c, roles in enumerate(["ssuua", "aau", "s", "uu", "xs"]) for t, r in enumerate(roles)]
    _, edited = conversations.plan_repairs(spark.createDataFrame(rows, SCHEMA).select("conv_id", "turn", "role", "text"))
    turns = sorted(map(tuple, conversations.repaired_turns(edited).collect()))
    for conv in range(5):
        assert re.fullmatch("(s?(ua)+)?", "".join(t[3][0] for t in turns if t[0] == conv))


def test_empty_conversations(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_conversations(table, table).collect() == []
    one = spark.createDataFrame([(4, 1, "user", "a.", 1, "f")], SCHEMA)
    (row,) = conversations.repair_conversations(one, one.where("false")).collect()
    assert columns(row) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
