import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at string, copies string, fault string"
EXTRA = ("c",) * 4
SPACES = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        stripped = text.strip(SPACES)
        out.append("blank" if not stripped else "duplicate" if (role, text) in seen else "" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """cost, audit, repaired: all edits by ascending cost, then audit."""
    faults = faults_of(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, "\n".join(lines)
        if (key := (audit, i, initials[-1:])) in done or cost > 4 * len(rows):
            continue
        done.add(key)
        options = []
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            options.append((4, "D", 1, None))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options.append((more, "K", 1, (role, text)))
                options += [(3 + more, "R", 1, (r, text)) for r in ("user", "assistant")]
        options += [(3, "I", 0, (r, "")) for r in ("user", "assistant")]
        for price, letter, step, row in options:
            new = initials + (row[0][:1] if row else "")
            if re.fullmatch("(s?(ua)*u?)?", new) and (not row or row[0]):
                heapq.heappush(heap, (cost + price, audit + letter, i + step, new, lines + ((":".join(row),) if row else ())))


def brute(rows):
    """``rows``: (turn, role, text) of a conversation."""
    rows = sorted(((t is not None, t or 0, r or " " if r is None else r, " " if x is None else x, t) for t, r, x in rows))
    pairs, turns = [(r[2], r[3]) for r in rows], [r[4] for r in rows if r[4] is not None]
    faults = faults_of(pairs)
    cost, audit, text = cheapest(pairs)
    firsts = [r[:1] for r, _ in pairs]
    illegal = sum(p + q not in ("su", "ua", "au") for p, q in zip(firsts, firsts[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def planted(seed, n, most=7):
    rng, out = random.Random(seed), {}
    for c in range(n):
        rows = []
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", "Yes.", f"Line {t}?", None, "end. ", "ünï."])
            rows += [(rng.choice([t, t, t, t + 2, None]), role, text)] * rng.choice([1, 1, 1, 1, 2])
        out[c] = rows
    return out


def answer(df, **kw):
    got = {r[0]: tuple(r[1:]) for r in repair.repair_conversations(df, **kw).collect()}
    return got


@pytest.mark.parametrize("block", [2, 1024])
def test_repair_equals_brute_force(spark, block):
    convs = planted(1, 150)
    df = spark.createDataFrame([(c, *r, *EXTRA) for c, rows in convs.items() for r in rows], SCHEMA)
    assert answer(df, block=block) == {c: brute(rows) for c, rows in convs.items()}


def test_damage_and_many_blocks(spark):
    """One conversation holds most rows; its blocks agree with a plain run."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system", "user"]), rng.choice([f"Text {t}.", f"Text {t}", "Again."]), *EXTRA) for t in range(900)]
    rows += [(8, t, "user", "Hi.", *EXTRA) for t in range(3)] + [(9, None, "user", "Hm.", *EXTRA)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, split = (answer(df, damaged=True, block=b) for b in (5000, 16))
    assert whole == split and set(whole) == {7, 8, 9}
    audit = whole[7][6]
    assert audit.count("I") and audit.count("D") and audit.count("R")


def test_damage_by_hash(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!", *EXTRA) for c in range(40) for t in [None, 0, 1, 2]]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (t, "user" if kind == 4 else role, {1: "", 2: "One Two"}.get(kind, text))
        want.setdefault(c, []).extend([] if kind == 0 else [row] * (2 if kind == 3 else 1))
    assert answer(df, damaged=True) == {c: brute(r) for c, r in want.items()}


def test_odd_rows(spark):
    """Null conversations are one, huge ids stay, long texts, copies, no rows."""
    long = "word " * 200_000 + "end."
    big = (1 << 60) + 1
    rows = [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (big, None, None, None), (3, 1, "user", long), (3, 2, "assistant", "No."), (4, 1, "u", "Yes.")]
    rows += [(5, 0, "user", "Same.")] * 3000 + [(6, (1 << 62), "user", "A."), (6, -(1 << 62) - 5, "assistant", "B.")]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    got = answer(df)
    assert got[None][6] == "KK" and got[big][6] == "D" and got[3][6] == "KK" and got[4][6] == "KI"
    assert got[3][7] == hashlib.sha256(f"user:{long}\nassistant:No.".encode()).hexdigest()
    assert got[5][:7] == (0, 0, 2999, 0, 2999, 4 * 2999 + 3, "K" + "D" * 2999 + "I")
    assert got[6][0] == (1 << 63) - 1  # the most that a long holds
    assert answer(df.limit(0)) == {}
    gone = repair.repair(df.where("conv_id = 3").select(F.col("conv_id").alias("conv"), "turn", "role", "text", F.lit(0).cast("long").alias("copies"))).collect()
    assert [tuple(r) for r in gone] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_blocks_fold_to_the_same_costs():
    rng = random.Random(2)
    for _ in range(200):
        items = [(rng.choice([-1, 1, 2, 3]), rng.choice([-1, 0, 0, 3]), rng.choice([0, 0, 2])) for _ in range(rng.randint(1, 9))]
        whole = repair.costs_back(items, repair.END)[0]
        cut = rng.randint(0, len(items))
        a, b = repair.table_of(items[:cut]), repair.table_of(items[cut:])
        after = [min(b[s][e] + repair.END[e] for e in range(4)) for s in range(4)]
        assert whole == [min(a[s][e] + after[e] for e in range(4)) for s in range(4)]
