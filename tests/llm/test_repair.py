"""Conversation repair against a search over all edit sequences."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest

from vicinage.llm import conversation_repair, queries

SMALL = "/root/testdata/sf0.001"
BLACK = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = [" " if x is None else x for x in (conv, turn, role, text)]
        case = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = spaced[2:]
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * ((case != 0) + (case == 3))
    return out


def brute_repair(rows):
    """rows of one conversation: (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        black = BLACK.findall(text)
        faults.append("blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(maxsize=None)
    def best(i, done):
        """Cheapest (cost, audit, edits) of the rows from i on, after the roles `done` (its last, or a start)."""
        ways = [(0, "", ())] if i == len(rows) and done in ("", "a") else []
        nexts = {"": "sua", "s": "u", "u": "a", "a": "u"}[done]
        if i < len(rows):
            cost, audit, edits = best(i + 1, done)
            ways.append((cost + 3, "D" + audit, (None, *edits)))
            if faults[i] in ("", "truncated"):
                extra = faults[i] == "truncated"
                _, role, text = rows[i]
                if role[:1] in nexts and role and not (done == "" and role[:1] == "a"):
                    cost, audit, edits = best(i + 1, role[:1])
                    ways.append((cost + extra, "K" + audit, ((role, text), *edits)))
                new = "assistant" if done == "u" else "user"
                cost, audit, edits = best(i + 1, new[0])
                ways.append((cost + 2 + extra, "R" + audit, ((new, text), *edits)))
        new = "assistant" if done == "u" else "user"
        if not (i == len(rows) and done in ("", "a")):
            if inserted.get((i, done), 0) < 2:
                inserted[i, done] = inserted.get((i, done), 0) + 1
                cost, audit, edits = after_insert(i, new[0], 1)
                ways.append((cost + 2, "I" + audit, ((new, ""), *edits)))
                inserted[i, done] -= 1
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    def after_insert(i, done, depth):
        """After an insert: more inserts or the row; at most three in a row can ever pay."""
        ways = []
        if i == len(rows) and done == "a":
            ways.append((0, "", ()))
        if i < len(rows):
            cost, audit, edits = best(i + 1, done)
            ways.append((cost + 3, "D" + audit, (None, *edits)))
            if faults[i] in ("", "truncated"):
                extra = faults[i] == "truncated"
                _, role, text = rows[i]
                if role[:1] and role[:1] in {"u": "a", "a": "u"}[done]:
                    cost, audit, edits = best(i + 1, role[:1])
                    ways.append((cost + extra, "K" + audit, ((role, text), *edits)))
                new = "assistant" if done == "u" else "user"
                cost, audit, edits = best(i + 1, new[0])
                ways.append((cost + 2 + extra, "R" + audit, ((new, text), *edits)))
        if depth < 3:
            new = "assistant" if done == "u" else "user"
            cost, audit, edits = after_insert(i, new[0], depth + 1)
            ways.append((cost + 2, "I" + audit, ((new, ""), *edits)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    inserted = {}
    cost, audit, edits = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    counts = Counter(faults)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in filter(None, edits)).encode()).hexdigest())


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
    for conv, turn, role, text in brute_damage(rows):
        convs[conv].append((turn, role, text))
    return {c: brute_repair(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))) for c, r in convs.items()}


def got(rows):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_repair_query(spark, folder):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    want = expected(rows)
    assert got(queries.QUERIES["op12_conversation_repair"](spark, folder).collect()) == want
    assert sum(w[5] for w in want.values()) > 0


def test_repair_odd_rows(spark):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "sys", "ape"], ["Yes.", "No", "", None, " \t", "Yes.", "ok!\n", " ", "é?", "x" * 3000]
    rows = [(c if c else None, t if rng.random() < 0.95 else None, rng.choice(roles[:3] if c % 2 else roles), rng.choice(texts) if c % 3 else f"{t}.")
            for c in range(60) for t in range(rng.choice([1, 2, 5, 9]))]
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values()) + [(900, t, "user", "a.") for t in range(40)] + [(901, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(300)]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "conv_id long, turn long, role string, text string, conv int, h int, letters string")
    want = expected(rows)
    damaged = conversation_repair.damaged(df)
    found = conversation_repair.repair(damaged, df).collect()
    assert got(found) == want and len(found) == len(want)
    turns = {}
    for r in sorted(conversation_repair.repaired_turns(damaged).collect(), key=lambda r: r["place"]):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv, parts in turns.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in parts))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in parts).encode()).hexdigest() == want[conv][-1]
    assert conversation_repair.repair(df.limit(0), df.limit(0)).collect() == []


def test_nodes_are_made_once_per_suffix(monkeypatch):
    """Signatures sorted from their ends: a letter that several share behind them is solved once."""
    turned = sorted(s[::-1] for s in ("aei", "bei", "cei", "i", "ei", "aeim"))
    nodes, last, made = [conversation_repair.END], "", 0
    for s in turned:
        shared = next((k for k in range(min(len(s), len(last))) if s[k] != last[k]), min(len(s), len(last)))
        del nodes[shared + 1:]
        for letter in s[shared:]:
            nodes.append(conversation_repair.node_before(letter, nodes[-1]))
            made += 1
        last = s
    assert made == len({s[k:] for s in ("aei", "bei", "cei", "i", "ei", "aeim") for k in range(len(s))})
