"""Conversation structure repair by Hirschberg's divide and conquer.

A repaired conversation reads, by the initials of its roles, ``(s?(ua)+)?``. Four states follow that
pattern: nothing yet, after s, after u, after a. A row is a step that costs so much from each state
to each other; steps in a row are again a step. From a start state forward and from the end
backward, vectors of four costs are carried to the middle of a conversation; where their sum is
least, the path crosses, and both halves are solved alike, so memory stays linear.

Several paths may cost the same; that with the least text of edits ("audit") counts. Up to a row,
the texts of paths to different states hold as many letters for rows and end in one, so they differ
and none begins another: which is less is settled before the crossing. The forward vector therefore
carries the order of its states by their least text, no texts.

A conversation of any length is cut into segments of bounded size. Each becomes one step, the steps
of a conversation are solved first, which gives the states between segments, and then each segment
on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from twinfold.operators.scratch import materialize
from twinfold.operators.skew import skew_join
from twinfold.sources.package import ship_package

# Costs of edits, and the states with what follows each.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {NOTHING: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
STATE_OF = {"u": AFTER_U, "a": AFTER_A}
ROLES = {"u": "user", "a": "assistant"}
ENDINGS = {NOTHING: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}  # inserts that complete the pattern
NEVER = 1 << 60

SEGMENT_ROWS = 4096
SEGMENT_BYTES = 4_000_000


class Step(NamedTuple):
    """Costs from state to state; ``order`` tells, for one state before, which way has the lesser text."""

    cost: tuple[tuple[int, ...], ...]
    order: tuple[tuple[int, ...], ...]


@lru_cache(maxsize=None)
def row_ways(initial: str, must_go: bool, truncated: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest (cost, edits) of one row by (state before, state after), inserts before it included."""
    ways: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(before: int, after: int, cost: int, edits: str) -> None:
        ways[before, after] = min(ways.get((before, after), (NEVER, "")), (cost, edits))

    for before in range(4):
        state = before
        for inserted in range(4):
            cost, edits = INSERT * inserted, "I" * inserted
            offer(before, state, cost + DELETE, edits + "D")
            if not must_go:
                kept = cost + TRUNCATED * truncated
                if initial == NEXT[state]:
                    offer(before, STATE_OF[initial], kept, edits + "K")
                elif initial == "s" and state == NOTHING:
                    offer(before, AFTER_S, kept, edits + "K")
                offer(before, STATE_OF[NEXT[state]], kept + REROLE, edits + "R")
            state = STATE_OF[NEXT[state]]
    return ways


@lru_cache(maxsize=None)
def row_step(initial: str, must_go: bool, truncated: bool) -> Step:
    ways = row_ways(initial, must_go, truncated)
    cost = tuple(tuple(ways.get((p, q), (NEVER, ""))[0] for q in range(4)) for p in range(4))
    order = tuple(_places([ways.get((p, q), (NEVER, "~"))[1] for q in range(4)]) for p in range(4))
    return Step(cost, order)


def _places(values: list) -> tuple[int, ...]:
    ranked = sorted(set(values))
    return tuple(ranked.index(v) for v in values)


def _forward(steps: list[Step], low: int, high: int, cost: list[int]) -> tuple[list[int], tuple[int, ...]]:
    """Least costs to each state after the steps, and the states' order by their least texts."""
    order: tuple[int, ...] = (0, 1, 2, 3)
    for costs, orders in steps[low:high]:
        came = []
        for q in range(4):
            best, least = 0, cost[0] + costs[0][q]
            for p in (1, 2, 3):
                total = cost[p] + costs[p][q]
                if total < least or total == least and order[p] < order[best]:
                    best, least = p, total
            came.append((min(least, NEVER), order[best], orders[best][q]))
        cost, order = [c for c, _, _ in came], _places([o[1:] for o in came])
    return cost, order


def _backward(steps: list[Step], low: int, high: int, cost: list[int]) -> list[int]:
    for costs, _ in reversed(steps[low:high]):
        cost = [min(NEVER, *map(int.__add__, row, cost)) for row in costs]
    return cost


def _only(state: int) -> list[int]:
    return [0 if q == state else NEVER for q in range(4)]


FINISH = [INSERT * len(ENDINGS[q]) for q in range(4)]


def crossings(steps: list[Step], start: int, end: list[int]) -> list[int]:
    """The state after each step on the cheapest path of the least text from ``start``; ``end`` holds
    what each last state costs."""
    found = [start] * len(steps)
    open_ = [(0, len(steps), start, end)] if steps else []
    while open_:
        low, high, before, after = open_.pop()
        middle = (low + high + 1) // 2
        cost, order = _forward(steps, low, middle, _only(before))
        rest = _backward(steps, middle, high, after)
        crossing = min(range(4), key=lambda q: (cost[q] + rest[q], order[q]))
        found[middle - 1] = crossing
        if middle - low > 1:
            open_.append((low, middle, before, _only(crossing)))
        if high > middle:
            open_.append((middle, high, crossing, after))
    return found


def joint_step(steps: list[Step]) -> Step:
    """Many steps as one."""
    ways = [_forward(steps, 0, len(steps), _only(p)) for p in range(4)]
    return Step(tuple(tuple(cost) for cost, _ in ways), tuple(order for _, order in ways))


def edits_of(rows: list[tuple[str, bool, bool]], states: list[int], start: int) -> Iterator[str]:
    """For each (initial, must go, truncated) row its edits, inserts before it first."""
    for row, before, after in zip(rows, [start, *states], states, strict=False):
        yield row_ways(*row)[before, after][1]


# ---------------------------------------------------------------- on Spark

WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
BATCH_ROWS, BATCH_LETTERS = 2000, 8_000_000


def _cut_schema(kind: str) -> str:
    return (f"pos bigint, conv_id {kind}, turn bigint, role string, text string, initial string, blank boolean,"
            " open_end boolean, what string, seg bigint, whole boolean")


def _piece_schema(kind: str) -> str:
    return (f"conv_id {kind}, seg bigint, first string, last string, low_turn bigint, high_turn bigint, turns bigint,"
            " blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string,"
            " lines array<struct<role: string, text: string>>")


def _report_schema(kind: str) -> str:
    return (f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
            " cost bigint, audit string, repaired_sha256 string")


def _mapped(df: DataFrame, make: Callable[[Iterator[dict]], Iterator[tuple[dict, int]]], schema: str) -> DataFrame:
    """``make`` over the rows of each task as dicts; it gives (row, letters), sent on in bounded batches."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = [], 0
        for row, size in make(row for batch in batches for row in batch.to_pylist()):
            held.append(row)
            letters += size
            if len(held) >= BATCH_ROWS or letters >= BATCH_LETTERS:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, letters = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return df.mapInArrow(run, schema)


def _cut(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    """Rows in order, as segments of one conversation: at most ``SEGMENT_ROWS`` rows and about
    ``SEGMENT_BYTES``. ``whole`` segments begin and end where another conversation does."""
    held: list[dict] = []
    size, begins = 0, False  # what stands before a partition is not known

    def flush(ends: bool) -> Iterator[tuple[dict, int]]:
        for row in held:
            yield row | {"seg": held[0]["pos"], "whole": begins and ends}, len(row["text"] or "")

    for row in rows:
        other = bool(held) and row["conv_id"] != held[0]["conv_id"]
        if held and (other or len(held) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
            yield from flush(other)
            held, size, begins = [], 0, other
        held.append(row)
        size += len(row["text"] or "")
    yield from flush(False)


def _by_segment(rows: Iterator[dict]) -> Iterator[tuple[list[dict], int, list[int]]]:
    """(rows, state before, costs after) of each segment: rows with their marks folded in."""
    for _, group in groupby(rows, key=lambda r: r["seg"]):
        found, before, end = [], NOTHING, FINISH
        for row in group:
            if row["mark"] == "states":
                before, end = row["before"], FINISH if row["after"] is None else _only(row["after"])
            elif row["mark"] == "repeated":
                if found and found[-1]["pos"] == row["pos"]:
                    found[-1]["repeated"] = True
            else:
                found.append(row | {"repeated": False})
        if found:
            yield found, before, end


def _faults(rows: list[dict]) -> list[tuple[str, bool, bool]]:
    return [(r["initial"], r["blank"] or r["repeated"], r["open_end"] and not r["blank"] and not r["repeated"]) for r in rows]


def _summarise(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    for own, _, _ in _by_segment(rows):
        step = joint_step([row_step(*f) for f in _faults(own)])
        yield {"conv_id": own[0]["conv_id"], "seg": own[0]["seg"], "cost": sum(step.cost, ()), "way": sum(step.order, ())}, 0


def _four(values: list[int]) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(values[k:k + 4]) for k in range(0, 16, 4))


def _join_segments(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    """The states between the segments of each conversation."""
    for _, group in groupby(rows, key=lambda r: r["conv_id"]):
        own = [(r["seg"], Step(_four(r["cost"]), _four(r["way"]))) for r in group]  # a row per segment
        states = crossings([step for _, step in own], NOTHING, FINISH)
        for (seg, _), before, after in zip(own, [NOTHING, *states], [*states[:-1], None], strict=False):
            yield {"seg": seg, "before": before, "after": after}, 0


def _piece(rows: list[dict], before: int, end: list[int]) -> dict:
    """One segment repaired."""
    faults = _faults(rows)
    states = crossings([row_step(*f) for f in faults], before, end)
    audit, lines, cost, state = [], [], 0, before
    for row, fault, edits, after in zip(rows, faults, edits_of(faults, states, before), states, strict=True):
        cost += row_ways(*fault)[state, after][0]
        audit.append(edits)
        for letter in edits:
            if letter == "D":
                continue
            role = ROLES[NEXT[state]]
            if letter == "K":
                lines.append({"role": row["role"], "text": row["text"]})
            else:
                lines.append({"role": role, "text": row["text"] if letter == "R" else ""})
            state = AFTER_S if letter == "K" and row["initial"] == "s" else STATE_OF[role[0]]
    if end is FINISH:
        audit.append(ENDINGS[state])
        cost += FINISH[state]
        for _ in ENDINGS[state]:
            role = ROLES[NEXT[state]]
            lines.append({"role": role, "text": ""})
            state = STATE_OF[role[0]]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["initial"] for r in rows]
    return {
        "conv_id": rows[0]["conv_id"], "seg": rows[0]["seg"], "first": initials[0], "last": initials[-1],
        "low_turn": min(turns, default=None), "high_turn": max(turns, default=None), "turns": len(set(turns)),
        "blank": sum(r["blank"] for r in rows), "duplicate": sum(r["repeated"] and not r["blank"] for r in rows),
        "truncated": sum(f[2] for f in faults), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": "".join(audit), "lines": lines}


def repair_conversations(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Repaired conversations, a row per segment in the order of (conv_id, seg): counts of faults, the
    cost, the edits by their initials and the repaired ``lines`` (role, text).

    Rows of a conversation stand by turn, nulls first, then by role and text. A row's first fault
    counts: blank (nothing but white space, or null), duplicate (role and text were seen earlier in the
    conversation, nulls being equal), truncated (its last character but white space is none of ``.!?``).
    Edits: keep, rerole to user or assistant (1), delete (2; blank and duplicate rows must go), insert an
    empty text of user or assistant (5); a truncated row that stays adds 5. The cheapest edits that
    give ``(s?(ua)+)?`` are taken, among equals those of the least text. A null or other role can be
    reroled, not kept. A null conv_id is a conversation; other columns are ignored; no rows, no segments.
    """
    spark = rows.sparkSession
    ship_package(spark)
    kind = rows.schema[conv_col].dataType.simpleString()
    bare = F.rtrim(F.coalesce(F.col("text"), F.lit("")), F.lit(WHITE))
    ordered = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"),
    ).repartitionByRange("conv_id", "turn", "role", "text", "_row").sortWithinPartitions(
        "conv_id", "turn", "role", "text", "_row").select(
        F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text",
        F.coalesce(F.left("role", F.lit(1)), F.lit("")).alias("initial"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open_end"),
        F.md5(F.to_json(F.struct("conv_id", "role", "text"))).alias("what"))
    cut = materialize(_mapped(ordered, _cut, _cut_schema(kind)), "segments")
    again = cut.groupBy("what").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).where("n > 1")
    marks = materialize(skew_join(cut.select("what", "seg", "pos"), again, "what", "n").where("pos > first_pos").select(
        "seg", "pos", F.lit("repeated").alias("mark")), "repeated")

    def gathered(rows: DataFrame, *more: DataFrame) -> DataFrame:
        """Rows by segment in their order, each followed by its marks: no join is needed."""
        rows = rows.withColumn("mark", F.lit(None).cast("string"))
        for part in more:
            rows = rows.unionByName(part, allowMissingColumns=True)
        return rows.repartition("seg").sortWithinPartitions("seg", "pos", F.coalesce("mark", F.lit("")))

    slim = cut.where("not whole").select("seg", "pos", "conv_id", "initial", "blank", "open_end")
    steps = _mapped(gathered(slim, marks), _summarise, f"conv_id {kind}, seg bigint, cost array<bigint>, way array<bigint>")
    states = materialize(_mapped(
        steps.repartition("conv_id").sortWithinPartitions("conv_id", "seg"), _join_segments,
        "seg bigint, before int, after int"), "states")
    states = states.withColumns({"pos": F.lit(-1).cast("bigint"), "mark": F.lit("states")})
    return _mapped(gathered(cut.drop("what", "whole"), marks, states), _repair, _piece_schema(kind))


def _repair(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    for own, before, end in _by_segment(rows):
        yield _piece(own, before, end), sum(len(r["text"] or "") for r in own)


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """(conv_id, seg, place, role, text): the rows of repaired conversations, in that order."""
    return pieces.select("conv_id", "seg", F.posexplode("lines").alias("place", "_line")).select(
        "conv_id", "seg", "place", "_line.role", "_line.text")


def _report(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    """The pieces of a conversation, in order, as one row; texts run through the digest and are not kept."""
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    for conv_id, group in groupby(rows, key=lambda r: r["conv_id"]):
        total, audit, digest = dict.fromkeys(counts, 0), [], hashlib.sha256()
        low = high = last = None
        turns, begun = 0, False
        for piece in group:
            for name in counts:
                total[name] += piece[name]
            total["illegal"] += last is not None and last + piece["first"] not in LEGAL
            last = piece["last"]
            if piece["turns"]:
                turns += piece["turns"] - (piece["low_turn"] == high)
                low, high = piece["low_turn"] if low is None else low, piece["high_turn"]
            audit.append(piece["audit"])
            for line in piece["lines"]:
                text = f"{line['role']}:{line['text']}"
                digest.update(f"\n{text}".encode() if begun else text.encode())
                begun = True
        yield {"conv_id": conv_id, "gaps": high - low + 1 - turns if turns else 0, **total,
               "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}, 0


def conversation_report(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation with rows: turns missing between the first and the last, faults, neighbouring roles
    whose initials are none of su, ua, au, the cost and initials of the edits, and the digest of the
    repaired ``role:text``, newline-joined. A digest is made in one sweep, so the pieces of a
    conversation stream through one task; all else of it was counted before, segment by segment."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return _mapped(ordered, _report, _report_schema(kind))


def damage_conversations(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows damaged by crc32 of ``conv:turn`` (nulls: one space) modulo 20: 0 drops a row, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats it, 4 sets the role to user. Null texts and roles stay null
    but where they are set; other columns stay."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    text = F.when(F.col("_tw_kind") == 1, "").when(F.col("_tw_kind") == 2, F.translate(text_col, ".!?", "")).otherwise(F.col(text_col))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_tw_kind") == 3, 2).otherwise(1)))
    return rows.withColumn("_tw_kind", kind).where("_tw_kind != 0").withColumns({
        text_col: text, role_col: F.when(F.col("_tw_kind") == 4, "user").otherwise(F.col(role_col)), "_tw_copy": copies,
    }).drop("_tw_kind", "_tw_copy")
