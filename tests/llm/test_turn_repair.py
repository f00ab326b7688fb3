"""Turn repair against enumeration of all edits, with blocks so short that conversations span many."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parleyspark.llm import queries
from parleyspark.llm import turn_repair as T

FORM = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """(role, text, fault) of sorted rows; the first fault counts."""
    out, seen = [], set()
    for role, text in rows:
        found = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append((role, text, "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def best_edits(rows):
    """(cost, audit, lines) of the best of all edits, with up to two insertions between rows and at the end."""
    found = []

    def close(cost, audit, lines):
        for end in ([], ["user:"], ["assistant:"], ["user:", "assistant:"]):
            if FORM.match("".join(x[:1] for x in lines + end)):
                found.append((cost + 3 * len(end), audit + "I" * len(end), lines + end))

    def go(k, cost, audit, lines):
        if not re.match(r"s?(ua)*u?\Z", "".join(x[:1] for x in lines)):
            return  # no continuation mends what stands
        if k == len(rows):
            close(cost, audit, lines)
            return
        role, text, fault = rows[k]
        for ins in ([], ["user:"], ["assistant:"], ["user:", "assistant:"], ["assistant:", "user:"]):
            at, front, extra = cost + 3 * len(ins), audit + "I" * len(ins), 3 * (fault == "truncated")
            go(k + 1, at + 4, front + "D", lines + ins)
            if fault not in ("blank", "duplicate"):
                go(k + 1, at + extra, front + "K", lines + ins + [f"{role}:{text}"])
                for other in ("user", "assistant"):
                    go(k + 1, at + 3 + extra, front + "R", lines + ins + [f"{other}:{text}"])

    go(0, 0, "", [])
    return min(found)


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())


def brute(rows):
    """Counts, cost, audit and hash of one conversation's (turn, role, text), nulls filled."""
    rows = sorted(rows, key=order)
    marked = faults([r[1:] for r in rows])
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = best_edits(marked)
    counts = [sum(f == x for *_, f in marked) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def got(spark, rows, block):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("place", F.lit("own"))
    out, counts = T.repair(frame, block)
    audits = {r["conv_id"]: (r["audit"], r["repaired_sha256"]) for r in T.digests(out).collect()}
    return {r["conv_id"]: (*r[1:], *audits[r["conv_id"]]) for r in counts.collect()}, out


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            role = rng.choices(["user", "assistant", "system", "tool", "", None], [6, 6, 2, 1, 1, 1])[0]
            text = rng.choice(["Fine.", "Yes!", "What? \n", "no end", "  \t", "", None, "Other.", f"Number {t}."])
            rows.append((None if c == 0 else c, rng.choice([t, t, t + 2, None]), role, text))
    return rows


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_against_enumeration(spark, block):
    rows = random_rows(5, 60, 5)
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t, " " if role is None else role, " " if text is None else text))
    found, _ = got(spark, rows, block)
    assert found == {c: brute(g) for c, g in groups.items()}


def test_blocks_do_not_matter(spark):
    rows = random_rows(8, 6, 120)
    assert got(spark, rows, 7)[0] == got(spark, rows, 1000)[0]


def test_repaired_turns_are_legal(spark):
    rows = random_rows(3, 40, 9)
    _, out = got(spark, rows, 4)
    turns = defaultdict(list)
    for r in T.repaired_turns(out).orderBy("conv_id", "place", "step").collect():
        assert (r["edit"] == "I") == (r["text"] == "" and r["turn"] is None and r["edit"] == "I") and r["role"]
        turns[r["conv_id"]].append(r["role"][0])
    assert all(FORM.match("".join(x)) for x in turns.values()) and turns


def test_ties_take_the_least_string():
    # user, user: delete either, or insert between
    rows = [("u", False, False), ("u", False, False)]
    found = T.edits(rows, T.START, None)
    assert ("".join(x for x, _, _ in found), sum(c for *_, c in found)) == ("KR", 3)
    assert T.edits([("a", True, False)], T.START, None) == [("D", [None], 4)]
    assert T.edits([("u", False, False)], T.START, None) == [("KI", [None, "assistant"], 3)]


def test_long_conversation(spark):
    """A conversation with most rows: 20,000 turns, every tenth repeated."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(20_000)] + [(1, t, "user", f"Turn {t}.") for t in range(0, 20_000, 10)] + [(2, 0, "user", "Hi.")]
    found, _ = got(spark, rows, 256)
    assert found[1][:6] == (0, 0, 2000, 0, 2000, 8000) and found[1][6].count("D") == 2000 and len(found[1][6]) == 22_000
    assert found[2][5:7] == (3, "KI")


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    rows, counts = T.repair(frame)
    assert rows.collect() == [] and counts.collect() == [] and T.digests(rows).collect() == [] and T.repaired_turns(rows).collect() == []


def test_damage(spark):
    rows = [(c, t, "user", "A b. C!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = defaultdict(list)
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        want[c, t] += [("user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    found = defaultdict(list)
    for r in queries.damaged(frame).collect():
        found[r["conv_id"], r["turn"]].append((r["role"], r["text"]))
    assert found == {k: v for k, v in want.items() if v}
