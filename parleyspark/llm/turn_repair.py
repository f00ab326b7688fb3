"""Conversation structure repair: the cheapest edits that make turns alternate, with their audit trail.

Roles may follow (s?(ua)+)?, by their initials. A row is kept (K), given the role that may follow (R), or deleted
(D); rows without text of the role that may follow can be inserted (I) anywhere. The least cost wins, then the
ASCII-least string of edits.

A path through the graph of (rows read, state of the pattern) weighs one integer: its cost in the high digits, and
below them one digit in base five for each edit, D 1 to R 4, at the place that the edit has in the audit; places
that are not used stay zero, so a string sorts before its continuations. The least integer at each node is the
answer. Every path to a node after a row ends in that row's edit, and an insertion costs, so of two such strings
neither begins with the other: the least integer stays least whatever follows.

Rows are counted in order of turn, and cut into blocks of `block` rows, so the width of an integer is bounded and a
conversation of any length is spread over tasks. A block in the middle is solved from each state it may begin in;
of its sixteen integers only costs and ranks are left. A pass over these few numbers finds the states at all
borders, and each block then writes its edits.

Defined results: nulls of role and text are one space, nulls of the conversation are one conversation, null turns
come first; rows of one turn are in order of role, then of SHA-256 of role and text; repeated rows are rows (all but
the first are duplicates); rows of a role with another initial, or none, cannot be kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parleyspark.llm.common import SPACE, join_small, keep, running

#: States of the pattern: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
#: State after the role that may follow, and that role.
NEXT = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
#: State after a kept row, by (state, initial).
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
#: Rows to insert at the end.
MISSING = [0, 2, 1, 0]
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BASE, LONGEST = 5, 3

Move = tuple[int, int, int, str]


def _coded(letters: str) -> int:
    """The letters as LONGEST digits, zeros at the end."""
    return sum(DIGIT[x] * BASE ** (LONGEST - 1 - k) for k, x in enumerate(letters))


@lru_cache(maxsize=64)
def moves(initial: str, doomed: bool, truncated: bool) -> list[Move]:
    """(state, next state, cost, edits) over one row, the best for each pair of states; doomed rows must go."""
    best: dict[tuple[int, int], tuple[int, int, str]] = {}
    for before in STATES:
        state = before
        for inserted in range(LONGEST):
            base = INSERT * inserted
            options = [(state, base + DELETE, "D")]
            if not doomed:
                options.append((NEXT[state], base + REROLE + TRUNCATED * truncated, "R"))
                if (state, initial) in KEPT:
                    options.append((KEPT[state, initial], base + TRUNCATED * truncated, "K"))
            for after, cost, letter in options:
                edits = "I" * inserted + letter
                found = (cost, _coded(edits), edits)
                best[before, after] = min(found, best.get((before, after), found))
            state = NEXT[state]
    return [(a, b, cost, edits) for (a, b), (cost, _, edits) in best.items()]


@lru_cache(maxsize=4)
def _places(width: int) -> list[int]:
    """Factor of LONGEST digits that begin at each place of a string of `width` digits."""
    return [BASE ** (width - LONGEST - p) for p in range(width - LONGEST + 1)]


Row = tuple[str, bool, bool]


def solve(rows: list[Row], start: int, width: int) -> list[dict[int, tuple[int, int, int, Move | None]]]:
    """For each number of rows read: (integer, edits so far, state before, move) of the best path to each state."""
    places, high = _places(width), BASE**width
    nodes: list[dict[int, tuple[int, int, int, Move | None]]] = [{start: (0, 0, start, None)}]
    for row in rows:
        now, after = nodes[-1], {}
        for move in moves(*row):
            if move[0] in now:
                value, length, _, _ = now[move[0]]
                value += move[2] * high + _coded(move[3]) * places[length]
                if move[1] not in after or value < after[move[1]][0]:
                    after[move[1]] = (value, length + len(move[3]), move[0], move)
        nodes.append(after)
    return nodes


def width_of(rows: int) -> int:
    return LONGEST * (rows + 1)


def summary(rows: list[Row], start: int) -> dict[int, tuple[int, int]]:
    """Cost and rank of the edits, by the state a block ends in."""
    width = width_of(len(rows))
    ends = solve(rows, start, width)[-1]
    ranked = sorted(ends, key=lambda q: ends[q][0] % BASE**width)
    return {q: (ends[q][0] // BASE**width, ranked.index(q)) for q in ends}


def last_state(ends: dict[int, tuple[int, int]]) -> int:
    """Best state at the end of a conversation, from (cost, rank) of each, with the rows that are missing there."""
    return min(ends, key=lambda q: (ends[q][0] + INSERT * MISSING[q], ends[q][1]))


def edits(rows: list[Row], start: int, end: int | None) -> list[tuple[str, list[str | None], int]]:
    """(edits, roles, cost) of each row on the best path to `end`; without one, to the end of the conversation.

    Roles are those of inserted and changed rows, null for kept and deleted ones. Rows that are missing at the end
    follow the last row's own edit.
    """
    width = width_of(len(rows))
    nodes = solve(rows, start, width)
    closing = 0
    if end is None:
        high = BASE**width
        end = last_state({q: divmod(nodes[-1][q][0], high) for q in nodes[-1]})
        closing = MISSING[end]
    path, state = [], end
    for at in range(len(rows), 0, -1):
        _, _, before, move = nodes[at][state]
        path.append(move)
        state = before
    out = []
    for state, _, cost, letters in reversed(path):
        roles: list[str | None] = []
        for x in letters:
            if x in "IR":
                state = NEXT[state]
            roles.append(ROLE[state] if x in "IR" else None)
        out.append((letters, roles, cost))
    for _ in range(closing):
        end = NEXT[end]
        letters, roles, cost = out[-1]
        out[-1] = (letters + "I", [*roles, ROLE[end]], cost + INSERT)
    return out


# --- Spark ------------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches as tuples, grouped by their first `key` values."""
    rows = (tuple(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[:key])


def _fold(blocks: DataFrame, kind: str) -> DataFrame:
    """(conv_id, block, start, end) of each block, from (conv_id, block, last, cells): two passes in order of blocks.

    A cell is (start, end, cost, rank). One row at a time is held of a conversation, whatever its length.
    """
    ids = to_arrow_type(blocks.schema["conv_id"].dataType)

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), group in _runs(batches, 1):
            ends = {START: (0, 0)}
            for _, block, last, cells in group:
                best: dict[int, tuple[int, int, int, int]] = {}
                for cell in cells:
                    a, b, cost, rank = cell["start"], cell["end"], cell["cost"], cell["rank"]
                    if a in ends:
                        found = (ends[a][0] + cost, ends[a][1], rank, a)
                        best[b] = min(found, best.get(b, found))
                ranked = sorted(best, key=lambda q: best[q][1:3])
                ends = {q: (best[q][0], ranked.index(q)) for q in best}
                came = [best[q][3] if q in best else None for q in STATES]
                final = last_state(ends) if last else None
                yield pa.RecordBatch.from_arrays([pa.array([conv], ids), pa.array([block], pa.int64()), pa.array([came], pa.list_(pa.int32())), pa.array([final], pa.int32())], ["conv_id", "block", "came", "final"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), group in _runs(batches, 1):
            state = None
            for _, block, came, final in group:
                state, end = (came[final], final) if final is not None else (came[state], state)
                # the last block's end is left open: its edits close the conversation
                yield pa.RecordBatch.from_arrays([pa.array([conv], ids), pa.array([block], pa.int64()), pa.array([state], pa.int32()), pa.array([None if final is not None else end], pa.int32())], ["conv_id", "block", "start", "end"])

    there = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(onward, f"conv_id {kind}, block bigint, came array<int>, final int")
    return keep(there).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(back, f"conv_id {kind}, block bigint, start int, end int")


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def ordered_rows(turns: DataFrame) -> DataFrame:
    """Narrow rows (row, conv_id, turn, place, initial, blank, duplicate, truncated) of (row, conv_id, turn, role, text).

    place counts a conversation's rows from 0. Only the first fault of a row is true.
    """
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    narrow = turns.select(
        "row", "conv_id", "turn", F.col("role").alias("rank_role"), digest.alias("digest"), _initial(F.col("role")).alias("initial"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("truncated"),
    )
    placed = keep(running(narrow, ["conv_id"], ["turn", "rank_role", "digest"]).withColumnRenamed("before", "place").drop("rank_role"))
    # keyed by place, so that no repeated text makes a key hot
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select(F.col("conv_id").alias("_conv"), F.col("place").alias("_place"))
    met = placed.join(firsts, placed["conv_id"].eqNullSafe(firsts["_conv"]) & (placed["place"] == firsts["_place"]), "left")
    again = ~F.col("blank") & F.col("_place").isNull()
    return met.select("row", "conv_id", "turn", "place", "initial", "blank", again.alias("duplicate"), (F.col("truncated") & ~F.col("blank") & ~again).alias("truncated"))


def plan_edits(placed: DataFrame, block: int = 256) -> DataFrame:
    """Add (edits, roles, cost) to ordered_rows: the edits of each row, with inserted rows around it."""
    kind = placed.schema["conv_id"].dataType.simpleString()
    ids = to_arrow_type(placed.schema["conv_id"].dataType)
    rows = placed.withColumn("block", F.floor(F.col("place") / block)).select("conv_id", "block", "place", "row", "initial", (F.col("blank") | F.col("duplicate")).alias("doomed"), "truncated")
    rows = keep(rows)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, number), group in _runs(batches, 2):
            of_block = [r[4:] for r in group]
            cells = []
            for start in STATES if number else [START]:
                cells += [{"start": start, "end": q, "cost": cost, "rank": rank} for q, (cost, rank) in summary(of_block, start).items()]
            shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([conv], ids), pa.array([number], pa.int64()), pa.array([cells], shape)], ["conv_id", "block", "cells"])

    long = keep(rows.groupBy("conv_id").agg(F.max("block").alias("last")).where("last > 0"))
    of_long = join_small(rows, long, ["conv_id"], "inner")
    found = of_long.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place").select("conv_id", "block", "place", "row", "initial", "doomed", "truncated")
    cells = keep(found.mapInArrow(summarise, f"conv_id {kind}, block bigint, cells array<struct<start: int, end: int, cost: bigint, rank: int>>"))
    marked = join_small(cells, long, ["conv_id"], "inner").select("conv_id", "block", (F.col("block") == F.col("last")).alias("last"), "cells")
    borders = keep(_fold(marked, kind))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in _runs(batches, 2):
            of_block = list(group)
            *_, start, end = of_block[0]
            found = edits([r[4:7] for r in of_block], START if start is None else start, end)
            out += [(r[3], *x) for r, x in zip(of_block, found, strict=True)]
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["row", "edits", "roles", "cost"])

    dealt = join_small(rows, borders, ["conv_id", "block"], "left").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    dealt = dealt.select("conv_id", "block", "place", "row", "initial", "doomed", "truncated", "start", "end")
    planned = dealt.mapInArrow(write, "row bigint, edits string, roles array<string>, cost bigint")
    return placed.join(planned, "row")


def illegal_pairs(placed: DataFrame, block: int = 256) -> DataFrame:
    """(conv_id, illegal): adjacent rows whose initials are not su, ua or au."""
    rows = placed.select("conv_id", "place", "initial", F.floor(F.col("place") / block).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("place")
    rows = rows.withColumn("before", F.lag("initial").over(inside))
    edge = rows.where(F.col("place") % block == block - 1).select("conv_id", (F.col("block") + 1).alias("block"), F.col("initial").alias("edge"))
    rows = join_small(rows, keep(edge), ["conv_id", "block"], "left")
    before = F.when(F.col("place") % block == 0, F.col("edge")).otherwise(F.col("before"))
    wrong = (F.col("place") > 0) & ~F.concat(before, "initial").isin("su", "ua", "au")
    return rows.groupBy("conv_id").agg(F.count_if(wrong).alias("illegal"))


def repair(turns: DataFrame, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of conversations (conv_id, turn, role, text).

    rows: conv_id, turn, place, role, text, edits, roles, cost of each row; repaired_turns() makes the repaired
    conversation of it. counts: conv_id, gaps, blank, duplicate, truncated, illegal, cost of each conversation.
    """
    named = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("row"))
    named = keep(named)
    placed = keep(ordered_rows(named))
    planned = keep(plan_edits(placed, block))
    missing = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    counts = planned.groupBy("conv_id").agg(missing.alias("gaps"), *[F.count_if(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum("cost").alias("cost"))
    beside = illegal_pairs(placed, block).withColumnRenamed("conv_id", "_conv")
    counts = counts.join(beside, counts["conv_id"].eqNullSafe(beside["_conv"])).drop("_conv")
    rows = named.join(planned.select("row", "place", "edits", "roles", "cost"), "row")
    return rows.select("conv_id", "turn", "place", "role", "text", "edits", "roles", "cost"), counts.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def made_turns(rows: DataFrame) -> Column:
    """Array of (edit, role, text) of a row of repair(): inserted rows have no text, deleted ones neither role nor text."""
    letters = F.split("edits", "")
    own = lambda e: e.isin("K", "R")
    return F.zip_with(
        letters, "roles",
        lambda e, r: F.struct(e.alias("edit"), F.when(e == "K", F.col("role")).otherwise(r).alias("role"), F.when(own(e), F.col("text")).when(e == "I", F.lit("")).alias("text")),
    )


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, step, edit, turn, role, text) of all edits but deletions: the repaired conversations, in order of place and step."""
    each = rows.select("conv_id", "place", "turn", F.posexplode(made_turns(rows)).alias("step", "made"))
    out = each.where("made.edit <> 'D'").select("conv_id", "place", "step", "made.edit", F.when(F.col("made.edit") != "I", F.col("turn")).alias("turn"), "made.role", "made.text")
    return out


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): all edits in order, and the hash of repaired `role:text` lines.

    A hash reads its text in order, so a conversation is one task's; it streams by, and only the edits are held.
    """
    kept = F.filter(made_turns(rows), lambda x: x["edit"] != "D")
    lines = F.array_join(F.transform(kept, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    narrow = rows.select("conv_id", "place", "edits", F.when(F.size(kept) > 0, lines).alias("lines"))
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), group in _runs(batches, 1):
            audit, digest, between = [], hashlib.sha256(), b""
            for _, _, letters, lines in group:
                audit.append(letters)
                if lines is not None:
                    digest.update(between + lines.encode("utf-8", "surrogatepass"))
                    between = b"\n"
            yield pa.RecordBatch.from_arrays([pa.array([conv], to_arrow_type(kind)), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, audit string, repaired_sha256 string")
