"""Repair of conversation structure by a dynamic program with checkpoints.

The roles of a repaired conversation have initials ``(s?(ua)+)?``. Rows are kept (cost
0), given the role that is needed (``R``, 3), deleted (``D``, 4; blank and duplicate rows
must be), or an empty user or assistant row is inserted (``I``, 3); truncated rows that
stay add 3. Of the cheapest edits those with the ASCII-least initials are taken.

The state is what the conversation ends with so far: nothing, ``s``, ``u`` or ``a``.

1. Equal rows are counted first, then all rows are sorted over the cluster by
   conversation and turn; a long conversation lies in many partitions.
2. Each stretch of at most ``block`` rows (the square root of the longest conversation,
   ``LEAST_BLOCK`` at least) becomes a block with its 4 x 4 table of least costs from
   state to state. A conversation of one block is repaired at once.
3. Of longer ones, block tables are folded from the back: the least cost of all that
   follows, by state, is held at block borders only (the checkpoints). Then blocks
   recompute their own costs, say where each state would leave them, and these maps are
   followed from the front; at last each block recomputes once more from its known state
   and emits the tight edits.

A task holds one block, or a few numbers per block of a conversation. The digest of a
long repaired conversation has no parallel form: its blocks stream through one task in
order.

Defined results: a null role or text is one space; a null conversation is one of its own;
null turns come first; rows of one turn are in order of role, then text; an empty role has
no initial, so that its row cannot be kept as it is; gaps beyond a long are its greatest
value; a conversation without rows gives
zeros, an empty audit and the digest of nothing; an empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import cut, hint_few

NONE, SYSTEM, USER, ASSISTANT = range(4)
INITIAL = ["", "s", "u", "a"]
#: The state after a user or assistant row that is inserted or given its role.
NEXT = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60
#: Costs by state when all rows are used up: a missing answer, or a turn of both.
END = [0, 2 * INSERT, INSERT, 0]
LEAST_BLOCK, BLOCK_BYTES = 1024, 4 << 20
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

# A row is a triple: the state it leads to if it is kept (-1: none), what it costs if it
# stays (-1: it must go), and how many copies of it must go after it.
Item = tuple[int, int, int]


def kept_state(state: int, leads: int) -> bool:
    """Whether a row that leads to ``leads`` may follow ``state`` as it is."""
    if leads == SYSTEM:
        return state == NONE
    return leads == NEXT[state]


def step_back(item: Item, after: list[int]) -> list[int]:
    """Least costs by state before ``item``, from those after it. Inserts come before
    the row that they serve."""
    leads, stay, copies = item
    cost = [DELETE * (copies + 1) + c for c in after]
    if stay < 0:
        return cost
    after = [DELETE * copies + c for c in after]
    for s in range(4):
        cost[s] = min(cost[s], RETYPE + stay + after[NEXT[s]])
        if kept_state(s, leads):
            cost[s] = min(cost[s], stay + after[leads])
    return inserted(cost)


def inserted(cost: list[int]) -> list[int]:
    """``cost`` where rows may be inserted first; two inserts reach every state."""
    for _ in range(2):
        cost = [min(c, INSERT + cost[NEXT[s]]) for s, c in enumerate(cost)]
    return cost


def costs_back(items: list[Item], end: list[int]) -> list[list[int]]:
    """Costs by state before each item, and ``end`` at last."""
    out = [end]
    for item in reversed(items):
        out.append(step_back(item, out[-1]))
    return out[::-1]


def walk(items: list[Item], costs: list[list[int]], state: int, at_end: bool) -> tuple[list[str], list[tuple[int, int]], int]:
    """The ASCII-least tight edits from ``state``; rows as (item or -1, state), and the
    state at the end. ``at_end``: what is missing there is inserted."""
    audit, rows = [], []
    for i, (leads, stay, copies) in enumerate(items):
        while True:
            left, after = costs[i][state], costs[i + 1]
            if left == DELETE * (copies + 1) + after[state]:
                audit.append("D" * (copies + 1))
                break
            if left == INSERT + costs[i][NEXT[state]]:
                audit.append("I")
                state = NEXT[state]
                rows.append((-1, state))
                continue
            keep = kept_state(state, leads) and left == stay + DELETE * copies + after[leads]
            state = leads if keep else NEXT[state]
            audit.append(("K" if keep else "R") + "D" * copies)
            rows.append((i, state if not keep else -state))
            break
    while at_end and costs[-1][state]:
        audit.append("I")
        state = NEXT[state]
        rows.append((-1, state))
    return audit, rows, state


def table_of(items: list[Item]) -> list[list[int]]:
    """Least cost from each state before the items to each state after them."""
    columns = [costs_back(items, [0 if s == e else FAR for s in range(4)])[0] for e in range(4)]
    return [[min(columns[e][s], FAR) for e in range(4)] for s in range(4)]


def item_of(role: str, fault: str, copies: int) -> Item:
    """``copies``: how many times the row is there."""
    leads = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], -1)
    if fault in ("blank", "duplicate"):
        return leads, -1, copies - 1
    return leads, TRUNCATED if fault == "truncated" else 0, copies - 1


def emit(roles: list[str], texts: list[str], rows: list[tuple[int, int]]) -> Iterator[str]:
    """Repaired rows as ``role:text``."""
    for i, state in rows:
        if i < 0:
            yield ROLE[state] + ":"
        else:
            yield (roles[i] if state < 0 else ROLE[state]) + ":" + texts[i]


# --------------------------------------------------------------- rows to blocks


def faults(rows: DataFrame) -> DataFrame:
    """Counted rows (conv, turn, role, text, copies) with ``fault``: blank, duplicate (the
    same role and text came earlier), truncated or none."""
    rows = rows.withColumn("digest", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    earliest = rows.groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("told"), "turn")).alias("first"))
    earliest = earliest.select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first.*").withColumnRenamed("turn", "least")
    seen = rows.join(earliest, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", "blank").when(~F.col("turn").eqNullSafe(F.col("least")), "duplicate")
    fault = fault.when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return seen.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


BLOCK = "conv string, at long, roles array<string>, texts array<string>, faults array<string>, copies array<long>, turns array<string>"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Stretches of sorted rows; ``at`` orders those of one conversation. A partition's
    blocks are numbered after those of the partitions before it."""
    key = ["conv", "turn", "role", F.substring("text", 1, 200)]
    # Rows that agree in the key stay together; their order is by whole texts.
    dealt = rows.repartitionByRange(*key).withColumn("at", F.spark_partition_id().cast("long") * (1 << 32))
    dealt = dealt.sortWithinPartitions("conv", "turn", "role", "text").withColumn("turn", F.col("turn").cast("string"))

    columns = ["role", "text", "fault", "copies", "turn"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        closed: list[dict] = []
        conv, size_now, number, waiting = None, 0, 0, 0

        def block() -> dict:
            fields = zip(["roles", "texts", "faults", "copies", "turns"], zip(*held))
            return {"conv": conv, "at": number} | {name: list(values) for name, values in fields}

        for b in batches:
            for c, at, *row in zip(*(b[x].tolist() for x in ("conv", "at", *columns))):
                if held and (c != conv or len(held) >= size or size_now > BLOCK_BYTES):
                    closed.append(block())
                    held, waiting, size_now, number = [], waiting + size_now, 0, number + 1
                    if waiting > BLOCK_BYTES or len(closed) >= 1000:
                        yield pd.DataFrame(closed)
                        closed, waiting = [], 0
                conv, number = c, max(number, at)
                held.append(tuple(row))
                size_now += len(row[1])
        if held:
            closed.append(block())
        if closed:
            yield pd.DataFrame(closed)

    return dealt.mapInPandas(build, BLOCK)


def items_of(r) -> list[Item]:
    """Dropped rows (no copies) mark a conversation only."""
    return [item_of(role, fault, int(n)) for role, fault, n in zip(r.roles, r.faults, r.copies) if n > 0]


def texts_of(r) -> tuple[list[str], list[str]]:
    there = [i for i, n in enumerate(r.copies) if n > 0]
    return [r.roles[i] for i in there], [r.texts[i] for i in there]


def measure(r) -> dict:
    """Counts of a block, and what its neighbours need: first and last turn and initial."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    turns, initials = [], []
    for turn, role, fault, n in zip(r.turns, r.roles, r.faults, r.copies):
        n = int(n)
        if not n:
            continue
        if turn is not None and (not turns or turns[-1] != int(turn)):
            turns.append(int(turn))
        out["duplicate"] += n - 1 if fault != "blank" else 0
        out["illegal"] += n - 1
        if fault:
            out[fault] += n if fault == "blank" else 1
        initials.append(role[:1])
    out["illegal"] += sum(p not in LEGAL for p in zip(initials, initials[1:]))
    return out | {
        "turns": len(turns), "least": turns[0] if turns else None, "most": turns[-1] if turns else None,
        "head": initials[0] if initials else None, "tail": initials[-1] if initials else None,
    }


LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def together(parts: list[dict]) -> dict:
    """Counts of a conversation from those of its blocks, in order."""
    out = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    told = [p for p in parts if p["turns"]]
    distinct = sum(p["turns"] for p in told) - sum(a["most"] == b["least"] for a, b in zip(told, told[1:]))
    out["gaps"] = min(told[-1]["most"] - told[0]["least"] + 1 - distinct, (1 << 63) - 1) if told else 0
    there = [p for p in parts if p["head"] is not None]
    out["illegal"] += sum((a["tail"], b["head"]) not in LEGAL for a, b in zip(there, there[1:]))
    return out


# ------------------------------------------------------------------- the repair


def repair(rows: DataFrame, block: int | None = None) -> DataFrame:
    """``rows``: conv, turn, role, text (no nulls in role and text) and copies (0: the row
    is gone, its conversation is not). Returns conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256; ``block`` sets the rows of a block."""
    kind = rows.schema["conv"].dataType
    rows = rows.withColumn("conv", F.col("conv").cast("string"))  # nulls and long numbers pass tasks as they are
    rows = cut(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    if block is None:
        longest = rows.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
        block = max(LEAST_BLOCK, int(np.ceil(np.sqrt(longest))))
    gone = rows.where("copies = 0").select("conv", "turn", "role", "text", "copies", F.lit("").alias("fault"))
    made = cut(blocks(faults(rows.where("copies > 0")).unionByName(gone), block))
    several = made.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"))
    several = hint_few(cut(several))
    # Conversations of several blocks are few: each has many rows.
    same = F.col("conv").eqNullSafe(F.col("c"))
    out = _short(made.join(several, same, "left_anti"))
    if not several.isEmpty():
        out = out.unionByName(_long(cut(made.join(several, same, "left_semi"))))
    return out.withColumn("conv", F.col("conv").cast(kind))


def _short(made: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                items = items_of(r)
                costs = costs_back(items, END)
                audit, rows, _ = walk(items, costs, NONE, True)
                digest = hashlib.sha256("\n".join(emit(*texts_of(r), rows)).encode()).hexdigest()
                out.append(together([measure(r)]) | {"cost": costs[0][NONE], "audit": "".join(audit), "repaired_sha256": digest})
            yield pd.DataFrame(out, columns=FIELDS).assign(conv=b["conv"])[["conv", *FIELDS]]

    return made.mapInPandas(run, f"conv string, {COUNTS}, audit string, repaired_sha256 string")


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
PART = "blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, head string, tail string"


def _long(made: DataFrame) -> DataFrame:
    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [measure(r) | {"cell": sum(table_of(items_of(r)), [])} for r in b.itertuples()]
            yield pd.concat([b[["conv", "at"]].reset_index(drop=True), pd.DataFrame(out).astype({"least": "Int64", "most": "Int64"})], axis=1)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        """Checkpoints: costs of all that follows a block; the counts go to the first."""
        part = part.sort_values("at")
        after, costs = [], END
        for cell in reversed(part["cell"].to_list()):
            after.append(costs)
            costs = [min(int(cell[4 * s + e]) + costs[e] for e in range(4)) for s in range(4)]
        counts = together([{k: None if pd.isna(v) else v for k, v in p.items() if k != "cell"} for p in part.drop(columns=["conv", "at"]).to_dict("records")])
        first = part["at"].iloc[0]
        out = part[["conv", "at"]].assign(after=after[::-1], last=part["at"] == part["at"].iloc[-1])
        for k, v in (counts | {"cost": costs[NONE]}).items():
            out[k] = pd.array([v if a == first else None for a in out["at"]], "Int64")
        return out

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                items = items_of(r)
                costs = costs_back(items, [int(c) for c in r.after])
                out.append([walk(items, costs, s, False)[2] if costs[0][s] < FAR else 0 for s in range(4)])
            yield b[["conv", "at"]].assign(exits=out)

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        state, entry = NONE, []
        for e in part["exits"]:
            entry.append(state)
            state = int(e[state])
        return part[["conv", "at"]].assign(entry=entry)

    def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                items = items_of(r)
                audit, rows, _ = walk(items, costs_back(items, [int(c) for c in r.after]), r.entry, bool(r.last))
                out.append({"audit": "".join(audit), "lines": list(emit(*texts_of(r), rows))})
            yield pd.concat([b[["conv", "at"]].reset_index(drop=True), pd.DataFrame(out, columns=["audit", "lines"])], axis=1)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, sha, some, any_ = None, hashlib.sha256(), False, False
        for b in batches:
            for c, lines in zip(b["conv"], b["lines"]):
                c = None if pd.isna(c) else c
                if any_ and c != conv:
                    yield pd.DataFrame({"conv": [conv], "repaired_sha256": [sha.hexdigest()]})
                    sha, some = hashlib.sha256(), False
                conv, any_ = c, True
                if len(lines):
                    sha.update((("\n" if some else "") + "\n".join(lines)).encode())
                    some = True
        if any_:
            yield pd.DataFrame({"conv": [conv], "repaired_sha256": [sha.hexdigest()]})

    told = made.mapInPandas(tables, f"conv string, at long, {PART}, cell array<long>")
    # One small row per block of a conversation: as many as the root of its rows.
    points = cut(told.groupBy("conv").applyInPandas(fold, f"conv string, at long, after array<long>, last boolean, {COUNTS}"))
    known = made.join(points.select(F.col("at").alias("p"), "after", "last"), F.col("at") == F.col("p")).drop("p")
    ways = known.mapInPandas(exits, "conv string, at long, exits array<int>")
    entry = cut(ways.groupBy("conv").applyInPandas(follow, "conv string, at long, entry int"))
    done = known.join(entry.select(F.col("at").alias("p"), "entry"), F.col("at") == F.col("p")).drop("p")
    done = cut(done.mapInPandas(edits, "conv string, at long, audit string, lines array<string>"))
    audits = done.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "audit"))).alias("parts"))
    audits = audits.select("conv", F.array_join(F.col("parts.audit"), "").alias("audit"))
    hashes = done.select("conv", "at", "lines").repartition("conv").sortWithinPartitions("conv", "at").mapInPandas(digest, "conv string, repaired_sha256 string")
    counts = points.where("cost IS NOT NULL").drop("at", "after", "last")
    named = lambda df, c: df.withColumnRenamed("conv", c)
    out = counts.join(named(audits, "c1"), F.col("conv").eqNullSafe(F.col("c1"))).join(named(hashes, "c2"), F.col("conv").eqNullSafe(F.col("c2")))
    return out.select("conv", *FIELDS)


# ------------------------------------------------------------- damage, and the whole


def plain_rows(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv, turn, role, text, copies: nulls of role and text as one space."""
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select(F.col(conv_col).alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.lit(1).cast("long").alias("copies"))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by crc32(``conv:turn``) % 20: 0 drops a row, 1 empties its text,
    2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's."""
    blank: Column = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long") * F.col("copies")
    # A row that is gone marks its conversation; such rows are one.
    return rows.select("conv", F.when(kind != 0, F.col("turn")).alias("turn"), F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", damaged: bool = False, block: int | None = None) -> DataFrame:
    """The repair of every conversation; with ``damaged``, of its damaged rows."""
    rows = plain_rows(conversations, conv_col)
    return repair(damage(rows) if damaged else rows, block).withColumnRenamed("conv", conv_col)
