"""Conversation repair against a plain search for the cheapest edits."""

import hashlib
import random
import re
import zlib

import pytest

from fieldloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, block int, at string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        rule = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if rule == 0:
            continue
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        out += [(conv, turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    return out


def plain_repair(rows):
    """The cheapest edits, least in ASCII, by forward search over all of them: cost, letters and repaired turns."""
    counts, seen, faults, roles = dict(blank=0, duplicate=0, truncated=0), set(), [], []
    for role, text in rows:
        inner = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        faults.append(fault)
        roles.append(role[:1])
    counts["illegal"] = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(roles, roles[1:]))
    best = {"": (0, "", ())}

    def extend(to, states):
        for shape, found in states:
            if shape not in to or found[:2] < to[shape][:2]:
                to[shape] = found

    def inserted(states):
        for _ in range(3):
            for shape, (cost, audit, made) in list(states.items()):
                for r in ("user", "assistant"):
                    if (onward := step(shape, r)) is not None:
                        extend(states, [(onward, (cost + 3, audit + "I", (*made, (r, ""))))])
        return states

    def step(shape, role):
        r = role[:1]
        if r == "s":
            return "s" if shape == "" else None
        if r == "u":
            return "u" if shape in ("", "s", "a") else None
        return "a" if r == "a" and shape == "u" else None

    for (role, text), fault in zip(rows, faults):
        new = {}
        for shape, (cost, audit, made) in inserted(best).items():
            extend(new, [(shape, (cost + 4, audit + "D", made))])
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            for letter, r, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                if (onward := step(shape, r)) is not None:
                    extend(new, [(onward, (cost + more + price, audit + letter, (*made, (r, text))))])
        best = new
    cost, audit, made = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])
    return counts, cost, audit, made


def plain(rows, everyone):
    out = {}
    for conv in everyone:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        counts, cost, audit, made = plain_repair([r[2:] for r in own])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, digest)
    return out


def conversations(seed, n, longest):
    r = random.Random(seed)
    said = ["Yes.", "No!", "what?", "and then", "", " ", "end.\n", "Yes", "ok.", "Ünd so.", "a "]
    rows = []
    for conv in [None, *range(n)]:
        for k in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "User"]) if r.random() < 0.3 else ("user", "assistant")[k % 2]
            turn = None if r.random() < 0.05 else k + (300 if r.random() < 0.1 else 0)
            text = None if r.random() < 0.05 else r.choice(said) if r.random() < 0.5 else f"{k} {r.random()}."
            rows += [(conv, turn, role, text)] * r.choice([1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("seed,n,longest,block", [(1, 60, 12, 256), (2, 40, 30, 3), (3, 4, 900, 64)])
def test_edits_are_the_cheapest_and_least(spark, monkeypatch, seed, n, longest, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = conversations(seed, n, longest)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    everyone = df.select("conv_id").distinct()
    got = {r[0]: tuple(r)[1:] for r in repair.repaired(repair.damaged(df), everyone).collect()}
    assert got == plain(plain_damage(rows), {r[0] for r in rows})


def test_turns_come_back_whole(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "And?"), (1, 4, "tool", "So it is."), (2, 0, "system", "Alone."), (3, 5, "assistant", "Hello!")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = repair.repaired_turns(df).orderBy("conv_id", "block", "at", "place").collect()
    made = [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in found]
    assert made[:5] == [(1, "K", "system", "Be kind."), (1, "K", "user", "Hi."), (1, "I", "assistant", ""), (1, "K", "user", "And?"), (1, "R", "assistant", "So it is.")]
    assert made[5:] == [(3, "I", "user", ""), (3, "K", "assistant", "Hello!")]
    told = {r["conv_id"]: (r["duplicate"], r["cost"], r["audit"]) for r in repair.repaired(df).collect()}
    assert told == {1: (1, 10, "KKDIKR"), 2: (0, 4, "D"), 3: (0, 3, "IK")}


def test_nothing_to_repair(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repaired(empty).collect() == [] and repair.repaired_turns(empty).collect() == []
    everyone = spark.createDataFrame([(5,), (None,)], "conv_id long")
    assert {tuple(r) for r in repair.repaired(empty, everyone).collect()} == {(k, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in (5, None)}


def test_one_conversation_is_dealt_out(spark, monkeypatch):
    """A long conversation with many copies of one turn: only narrow rows of its blocks are streamed."""
    monkeypatch.setattr(repair, "BLOCK", 16)
    rows = [(9, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(2000)] + [(9, 7, "assistant", "again.")] * 500
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = repair.repaired(df).collect()[0]
    assert found["duplicate"] == 499 and found["audit"].count("D") == 499 and len(found["audit"]) == 2501
    assert found["cost"] == 4 * 499 + 3 and found["illegal"] == 500
    assert repair._coded(df).groupBy("block").count().agg({"count": "max"}).collect()[0][0] <= 17
