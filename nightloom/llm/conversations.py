"""Repair of conversations' structure by weighted finite-state composition.

A conversation is an acceptor of its rows' classes; a transducer edits them (keep, rerole, delete, insert, each at a cost); an
acceptor holds the grammar of roles. Their composition is built lazily: arcs only for the classes and grammar states that are
met. From a state each edit leads to one state, so the least (cost, label string) path is found in two walks along the
topological order: least costs from the end to the start, then forth, taking the least label that keeps the cost.

Rows are range-sorted by conversation and turn without their texts, and each task searches its range. A conversation that goes
over several ranges is searched in pieces: each piece gives a matrix of least costs between grammar states, the matrices are
multiplied from the end (one for each range), and every piece then knows the costs behind it and, in one more pass, the state
it starts from. Texts are shuffled once, to meet the edits in order; a digest over a whole conversation can only be computed in
one go, so one task reads a conversation's rows, as a stream.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.llm.common import settle

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What an undeleted row without an ending mark adds.
UNENDED = 3
ENDS = "[.!?]"
#: The grammar s?(ua)+ or nothing: state -> role initial -> state; an empty conversation and one that ends on an answer are right.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL, START = (0, 3), 0
STATES = tuple(GRAMMAR)
#: Roles that edits may write, by initial.
ROLES = {"a": "assistant", "u": "user"}
BLANK, DUPLICATE, TRUNCATED, FINE = "blank", "duplicate", "truncated", ""
FAR = 1 << 40
LEGAL = ("su", "ua", "au")


class Arc(NamedTuple):
    """An arc of the composition: an insert reads nothing, the other edits read a row."""

    label: str
    cost: int
    to: int
    role: str | None  # what it writes: an initial; None for nothing


@cache
def arcs(initial: str, fault: str, state: int) -> tuple[Arc, ...]:
    """The arcs from a grammar state at a row, in order of their labels."""
    follow, more = GRAMMAR[state], UNENDED if fault == TRUNCATED else 0
    found = [Arc(DELETE, COSTS[DELETE], state, None), *inserts(state)]
    if fault not in (BLANK, DUPLICATE):
        if initial in follow:
            found.append(Arc(KEEP, COSTS[KEEP] + more, follow[initial], initial))
        found += [Arc(REROLE, COSTS[REROLE] + more, follow[r], r) for r in ROLES if r in follow]
    return tuple(sorted(found))


@cache
def inserts(state: int) -> tuple[Arc, ...]:
    return tuple(Arc(INSERT, COSTS[INSERT], GRAMMAR[state][r], r) for r in ROLES if r in GRAMMAR[state])


def closed(costs: list[int]) -> tuple[int, ...]:
    """Least costs when inserts may come first; to come back to a state by inserts never pays, so as many rounds as states do."""
    for _ in STATES:
        costs = [min([costs[q], *(a.cost + costs[a.to] for a in inserts(q))]) for q in STATES]
    return tuple(costs)


#: Least costs from each state after the last row.
AT_END = closed([0 if q in FINAL else FAR for q in STATES])


@cache
def before(initial: str, fault: str, after: tuple[int, ...]) -> tuple[int, ...]:
    return closed([min(a.cost + after[a.to] for a in arcs(initial, fault, q) if a.label != INSERT) for q in STATES])


def step_back(row: tuple[str, str], after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs before a row from those after it. Costs are remembered less their least, of which there are few."""
    least = min(after)
    return tuple(least + c for c in before(*row, tuple(min(c - least, FAR) for c in after)))


def costs_back(rows: list[tuple[str, str]], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least costs from each state before each row, and after the last."""
    found = [end]
    for row in reversed(rows):
        found.append(step_back(row, found[-1]))
    return found[::-1]


def walk(rows: list[tuple[str, str]], costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[list[str], int]:
    """Each row's labels on the least path from ``state`` (its inserts, then its own edit), with what is inserted after the last
    row as one more entry, and the state at the end."""
    labels = []
    for i, row in enumerate(rows):
        mine = ""
        while True:
            arc = next(a for a in arcs(*row, state) if a.cost + costs[i if a.label == INSERT else i + 1][a.to] == costs[i][state])
            mine, state = mine + arc.label, arc.to
            if arc.label != INSERT:
                break
        labels.append(mine)
    mine = ""
    while last and state not in FINAL:
        mine, state = mine + INSERT, inserts(state)[0].to
    return [*labels, mine], state


def product(rows: list[tuple[str, str]]) -> list[list[int]]:
    """Least costs from state to state over the rows: a column for each state that they may end in."""
    ends = [costs_back(rows, closed([0 if q == r else FAR for q in STATES]))[0] for r in STATES]
    return [[min(ends[r][q], FAR) for r in STATES] for q in STATES]


# --- damage, and rows without texts ---------------------------------------------------------------------------------------


def or_space(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after a damage that crc32 of ``conv_id:turn`` names: of 20 remainders 0 drops the row, 1 empties its
    text, 2 removes its ending marks, 3 repeats it, 4 makes it the user's. Nulls but in conv_id and turn become one space."""
    kind = F.crc32(F.concat_ws(":", or_space("conv_id"), or_space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space("text"), ENDS, "")).otherwise(or_space("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"), kind.alias("__kind"))
    return rows.filter("__kind <> 0").withColumn("__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__kind", "__copy")


#: Rows of a conversation come by turn, nulls first; rows of one turn by role and text (its first characters, then its digest).
HEAD = 16
PLACE = ["has_turn", "turn", "role", "head", "same"]


def keyed(conversations: DataFrame) -> DataFrame:
    """conv_id, what PLACE names, and text; nulls in role and text are one space."""
    text = or_space("text")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), or_space("role").alias("role"), text.alias("text"))
    return rows.select("conv_id", "has_turn", "turn", "role", F.substring("text", 1, HEAD).alias("head"), F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("same"), "text")


def classes(rows: DataFrame) -> DataFrame:
    """A row for each distinct row of ``keyed``, without its text: conv_id, PLACE, copies, fault of the first copy; the others are
    duplicates. First occurrences are counted in as rows of no copies, so that one aggregation marks them, whatever repeats."""
    bare = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    fault = F.when(F.length(bare) == 0, BLANK).when(~F.substring(bare, -1, 1).rlike(ENDS), TRUNCATED).otherwise(FINE)
    slim = rows.select("conv_id", *PLACE, fault.alias("fault"))
    first = slim.groupBy("conv_id", "role", "head", "same", "fault").agg(F.min(F.struct("has_turn", "turn")).alias("at"))
    first = first.select("conv_id", "at.has_turn", "at.turn", "role", "head", "same", "fault", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("first"))
    every = slim.withColumns({"copies": F.lit(1).cast("long"), "first": F.lit(False)}).unionByName(first)
    found = every.groupBy("conv_id", *PLACE, "fault").agg(F.sum("copies").alias("copies"), F.max("first").alias("first"))
    return found.withColumn("fault", F.when((F.col("fault") == BLANK) | F.col("first"), F.col("fault")).otherwise(DUPLICATE)).drop("first")


# --- the search over ranges ----------------------------------------------------------------------------------------------

SLIM = "conv_id long, has_turn boolean, turn long, role string, head string, same binary, fault string, copies long"


def classes_of(row: dict[str, Any]) -> list[tuple[str, str]]:
    """The classes of a distinct row's copies: further copies of a blank row are blank, of another they are duplicates."""
    initial = row["role"][:1]
    return [(initial, row["fault"])] + [(initial, BLANK if row["fault"] == BLANK else DUPLICATE)] * (row["copies"] - 1)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[dict[str, Any]]]]:
    """(conv_id, its distinct rows) of a sorted range."""
    held: list[dict[str, Any]] = []
    for b in batches:
        for row in b.to_pylist():
            if held and held[-1]["conv_id"] != row["conv_id"]:
                yield held[0]["conv_id"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["conv_id"], held


class Piece(NamedTuple):
    """The part of a conversation in one range: least costs behind it, the state that it starts from, whether it is the last."""

    end: tuple[int, ...] = AT_END
    start: int = START
    last: bool = True


def spread_over(ranges: DataFrame) -> dict[tuple[int | None, int], Piece]:
    """The pieces of the conversations that go over several ranges, by (conv_id, range). Only the first and the last conversation
    of a range do, so what reaches the driver is a matrix of 16 numbers or two for each range."""
    ids = ranges.groupBy("conv_id").agg(F.min("__p").alias("lo"), F.max("__p").alias("hi")).filter("lo < hi").select(F.col("conv_id").alias("__conv"))
    part = settle(ranges.join(F.broadcast(ids), F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi"))  # no more ids than ranges

    def matrices(batches):
        for conv, rows in by_range(batches):
            yield conv, rows[0]["__p"], [x for line in product([c for r in rows for c in classes_of(r)]) for x in line]

    found = defaultdict(list)
    for r in part.mapInArrow(emitting(matrices, MATRIX), MATRIX).collect():
        found[r["conv_id"]].append((r["p"], r["m"]))
    known: dict[tuple[int | None, int], Piece] = {}
    for conv, parts in found.items():
        after, last = AT_END, True
        for p, m in sorted(parts, reverse=True):
            known[conv, p], last = Piece(end=after, last=last), False
            after = tuple(min(m[q * len(STATES) + r] + after[r] for r in STATES) for q in STATES)

    def moves(batches):
        for conv, rows in by_range(batches):
            every = [c for r in rows for c in classes_of(r)]
            costs = costs_back(every, known[conv, rows[0]["__p"]].end)
            yield conv, rows[0]["__p"], [walk(every, costs, q, False)[1] for q in STATES]

    state: dict[int | None, int] = {}
    for r in sorted(part.mapInArrow(emitting(moves, MATRIX), MATRIX).collect(), key=lambda r: r["p"]) if known else ():
        at, start = (r["conv_id"], r["p"]), state.get(r["conv_id"], START)
        known[at], state[r["conv_id"]] = known[at]._replace(start=start), r["m"][start]
    return known


MATRIX = "conv_id long, p int, m array<long>"


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[dict[str, Any]]]]:
    """``pieces`` where a task may hold several ranges."""
    for conv, rows in pieces(batches):
        held: dict[int, list] = defaultdict(list)
        for r in rows:
            held[r["__p"]].append(r)
        for p in sorted(held):
            yield conv, held[p]


def emitting(rows_of: Callable, schema: str, size: int = 4096) -> Callable:
    """A function for mapInArrow from a generator of tuples."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows_of(batches):
            held.append(row)
            if len(held) >= size:
                yield batch(held)
                held = []
        yield batch(held)

    return run


EDITS = SLIM + ", labels array<string>, after string"


def edited(rows: DataFrame) -> DataFrame:
    """The distinct rows of ``keyed`` with ``labels`` (the edits of each copy, inserts before them first) and ``after`` (what is inserted
    behind the conversation's last row)."""
    order = ["conv_id", *PLACE]
    ranges = classes(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ranges = settle(ranges)
    known = spread_over(ranges)

    def search(batches):
        for conv, rows in by_range(batches):
            piece = known.get((conv, rows[0]["__p"]), Piece())
            every = [c for r in rows for c in classes_of(r)]
            labels, _ = walk(every, costs_back(every, piece.end), piece.start, piece.last)
            place = 0
            for k, r in enumerate(rows):
                mine, place = labels[place : place + r["copies"]], place + r["copies"]
                yield *(r[c] for c in ("conv_id", *PLACE, "fault", "copies")), mine, labels[-1] if k == len(rows) - 1 else ""

    return ranges.mapInArrow(emitting(search, EDITS), EDITS)


# --- texts and edits meet ------------------------------------------------------------------------------------------------

MARK, TEXT, EDIT = 0, 1, 2


def together(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Texts and edits of each conversation in one partition and in order; ``ids``: conversations that appear even without rows."""
    nothing = {"labels": F.lit(None).cast("array<string>"), "after": F.lit(None).cast("string"), "fault": F.lit(None).cast("string")}
    texts = rows.withColumns({"kind": F.lit(TEXT), **nothing})
    edits = edited(rows).drop("copies").withColumns({"kind": F.lit(EDIT), "text": F.lit(None).cast("string")})
    both = texts.unionByName(edits)
    if ids is not None:
        both = ids.select(F.col("conv_id").cast("long")).distinct().withColumn("kind", F.lit(MARK)).unionByName(both, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", *(F.asc_nulls_first(c) for c in PLACE), "kind")


class Met(NamedTuple):
    """A row of a conversation, or an insert: what it was, what becomes of it."""

    turn: int | None
    role: str | None
    text: str
    fault: str
    label: str
    written: str | None  # the role in the repaired conversation


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Met | None]]:
    """(conv_id, row) in order; (conv_id, None) comes first for each conversation."""
    conv, text, state, begun = None, "", START, False

    def write(label: str, role: str) -> str | None:
        nonlocal state
        if label == DELETE:
            return None
        if label == KEEP:
            state = GRAMMAR[state][role[:1]]
            return role
        initial = next(r for r in ROLES if r in GRAMMAR[state])
        state = GRAMMAR[state][initial]
        return ROLES[initial]

    for b in batches:
        for r in b.to_pylist():
            if not begun or r["conv_id"] != conv:
                conv, state, begun = r["conv_id"], START, True
                yield conv, None
            if r["kind"] == TEXT:
                text = r["text"]
            elif r["kind"] == EDIT:
                turn = r["turn"] if r["has_turn"] else None
                for n, labels in enumerate(r["labels"]):
                    for label in labels[:-1]:
                        yield conv, Met(None, None, "", FINE, label, write(label, ""))
                    fault = r["fault"] if not n or r["fault"] == BLANK else DUPLICATE
                    yield conv, Met(turn, r["role"], text, fault, labels[-1], write(labels[-1], r["role"]))
                for label in r["after"]:
                    yield conv, Met(None, None, "", FINE, label, write(label, ""))


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0 in each conversation), edit (K, R or I), turn (null for inserts), role, text.

    Input: conv_id, turn, role, text; other columns are ignored. A conversation's rows come by turn, nulls first, rows of one
    turn by role and text. A null id is a conversation like others, a null role or text one space. An empty role has no
    initial and is never right. Blank rows and rows that repeat an earlier role and text go; the roles of the rest become
    ``s?(ua)+`` or nothing at the least cost, of several ways by the one whose edits are least as a string. No rows: no rows.
    """

    def rows_of(batches):
        place = 0
        for conv, m in met(batches):
            if m is None:
                place = 0
            elif m.written is not None:
                yield conv, place, m.label, m.turn, m.written, m.text
                place += 1

    return together(keyed(conversations)).mapInArrow(emitting(rows_of, REPAIRED), REPAIRED)


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audited(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of ``conversations`` and ``ids``: gaps in its turns, rows by their first fault, illegal neighbours,
    the least cost, the edits, and the digest of what ``repaired`` gives. Conversations without rows have zeros, no edits and
    the digest of nothing. Input and cases as for ``repaired``.
    """

    def rows_of(batches):
        held = None

        def row(conv):
            turns, counts, illegal, cost, audit, sha = held["turns"], held["faults"], held["illegal"], held["cost"], held["audit"], held["sha"]
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            return conv, gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, "".join(audit), sha.hexdigest()

        last = None
        for conv, m in met(batches):
            if m is None:
                if held:
                    yield row(last)
                last, held = conv, {"turns": None, "faults": defaultdict(int), "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "role": None, "any": False}
                continue
            held["audit"].append(m.label)
            held["cost"] += COSTS[m.label] + (UNENDED if m.fault == TRUNCATED and m.label != DELETE else 0)
            if m.role is not None:
                held["faults"][m.fault] += 1
                held["illegal"] += held["role"] is not None and held["role"] + m.role[:1] not in LEGAL
                held["role"] = m.role[:1]
                if m.turn is not None:
                    lo, hi, n = held["turns"] or (m.turn, m.turn, 1)
                    held["turns"] = lo, m.turn, n + (m.turn != hi)
            if m.written is not None:
                held["sha"].update(("\n" if held["any"] else "").encode() + f"{m.written}:{m.text}".encode())
                held["any"] = True
        if held:
            yield row(last)

    return together(keyed(conversations), ids).mapInArrow(emitting(rows_of, AUDIT), AUDIT)
