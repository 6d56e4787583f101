r"""Conversation structure repair: cost DP, then the least audit by prefix-doubling ranks.

Rows of a conversation are taken by turn (nulls first), rows of one turn by role and text. A row's first fault
counts: blank, duplicate (role and text seen earlier) or truncated. Edits are K (keep, 0), R (rerole to user or assistant, 1),
D (delete, 2; required for blank and duplicate rows) and I (insert an empty user or assistant, 5); a truncated row
that stays adds 5. The repaired role initials match `(s?(ua)+)?`, a machine of four states: nothing yet, after s, after
u, after a. An audit is the string of edits; of the cheapest ones the least is taken.

A node is (rows consumed, state). Backward costs fix its optimal arcs, whose letters differ. Nodes are ranked by the least
audit of length 1, 2, 4, ...: the rank of a doubled length is that of the pair (own rank, rank of the node
that the pointer reaches), and the pointer is followed twice. The arcs of least letter and rank make the least path, and the
doubled pointers mark all its nodes at once.

No conversation is gathered in a group. Rows are numbered over the whole table and solved in blocks of
`BLOCK_ROWS`, without their texts. A block's first and last conversations may go on in others: such a piece is first
reduced to a 4 x 4 matrix of least costs, the matrices of a conversation (one per block) give every piece the costs of what
follows it, and the piece is then solved from each of its four possible states. At last every conversation's rows
stream in order past their edits, in bounded memory; one SHA-256 needs them in sequence.

Defined results: null roles and texts are one space, null ids and turns one space in the checksum's key; null ids are
one conversation; a role without a first character has no legal initial; rows that agree in all four columns are rows of their
own; an empty table gives an empty one; the input's other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import numbered, stage_text
from riskframe.session import stage_table

BLOCK_ROWS = 4_096
PREFIX = 64  # characters of a text that cut the partitions of the numbering
NO_ROW = 12  # class of a row that the damage dropped
INF = 1 << 40

# the machine: states 0 nothing yet, 1 after s, 2 after u, 3 after a
INITIALS = "sua"
STEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by initial (s, u, a, other) and state
ADDED = np.array([2, 2, 3, 2])  # the state after inserting, or reroling to, the only legal role
FINAL = np.array([0, 10, 5, 0])  # least cost of inserts after the last row
LETTERS = np.array(["", "D", "I", "K", "R"])  # by code, in ASCII order; 0 ends a path

# a row's class is 3 * initial + fault, faults being none, truncated, must go
_TO = np.where(STEP < 0, 0, STEP).repeat(3, axis=0)
_KEEP = np.where(STEP < 0, INF, 0).repeat(3, axis=0) + np.tile([0, 5, INF], 4)[:, None]
_REROLE = np.tile([1, 6, INF], 4)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after damage by the checksum of id and turn: conv, turn, role, text, dropped, copy. Dropped rows stay marked."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    t = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), act.alias("act")
    )
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(0), F.when(F.col("act") == 3, 1).otherwise(0))
    return t.select(
        "conv", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("act") == 0).alias("dropped"), F.explode(copies).alias("copy"),
    )


def _fault(repeated: Column) -> Column:
    """0 none, 1 truncated, 2 blank, 3 duplicate."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(blank, 2).when(repeated, 3).when(whole, 0).otherwise(1)


def faulted(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Damaged rows numbered by conversation and turn (`at`), with their block, fault and class; written once."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    bounds = [*order[:2], F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)]
    key = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    t = numbered(damaged(rows).withColumn("key", key), order, "at", bounds)
    # values found again in a conversation: counted map-side first, so a value in a third of all rows is a row a task
    seen = t.filter("not dropped").groupBy("conv", "key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = seen.select(F.col("conv").alias("_conv"), F.col("key").alias("_key"), "first")
    t = t.join(again, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    t = t.withColumn("fault", _fault(F.coalesce(F.col("at") > F.col("first"), F.lit(False))))
    kind = F.when(F.col("dropped"), NO_ROW).otherwise(3 * initial + F.least("fault", F.lit(2)))
    block = F.floor(F.col("at") / block_rows).alias("block")
    return stage_table(t.select("conv", "at", block, "turn", "role", "text", "dropped", "fault", kind.alias("kind")), "faulted")


def _pieces(conv: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of every stretch of rows of one conversation."""
    codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.r_[0, np.flatnonzero(np.diff(codes)) + 1]
    return starts, np.diff(np.r_[starts, len(codes)])


def _before(kinds: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs of the nodes before a row, by state, from those after it; `after` has a last axis of states."""
    lead = (slice(None),) + (None,) * (after.ndim - 2)
    keep = np.take_along_axis(after, np.broadcast_to(_TO[kinds][lead], after.shape), -1) + _KEEP[kinds][lead]
    least = np.minimum(np.minimum(after + 2, keep), after[..., ADDED] + _REROLE[kinds][lead][..., None])
    user, assistant = least[..., 2].copy(), least[..., 3].copy()
    least[..., 2] = np.minimum(user, assistant + 5)
    least[..., 3] = np.minimum(assistant, user + 5)
    least[..., :2] = np.minimum(least[..., :2], least[..., 2:3] + 5)
    return np.minimum(least, INF)


def _costs(kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray):
    """Yield (pieces, row, costs before it), from the last row of the pieces to the first; pieces go in step."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, costs = starts[order], lengths[order], ends[order].copy()
    for t in range(1, int(lengths[0]) + 1):  # the t-th row from the end
        n = int(np.searchsorted(-lengths, -t, "right"))
        rows = starts[:n] + lengths[:n] - t
        costs[:n] = _before(kinds[rows], costs[:n])
        yield order[:n], rows, costs[:n]


EDGES = "block long, costs array<long>"


def _edges(table: pa.Table) -> pa.Table:
    """The least costs between the states of the first and the last piece of a block (from state, to state)."""
    table = table.sort_by("at")
    starts, lengths = _pieces(table["conv"].combine_chunks())
    edge = sorted({0, len(starts) - 1})
    starts, lengths = starts[edge], lengths[edge]
    unit = np.where(np.eye(4, dtype=bool), 0, INF)
    ends = np.broadcast_to(unit, (len(edge), 4, 4))  # one end state a row
    out = np.array(ends)
    for pieces, _, costs in _costs(table["kind"].to_numpy(), starts, lengths, ends):
        out[pieces] = costs
    matrices = out.transpose(0, 2, 1).reshape(len(edge), 16)
    columns = [table["conv"].take(starts), table["block"].take(starts), pa.array(matrices.tolist(), pa.list_(pa.int64()))]
    return pa.table(dict(zip(["conv", "block", "costs"], columns)))


def _following(pieces: pd.DataFrame) -> pd.DataFrame:
    """The costs of all that follows each piece of a cut conversation, one piece a block; others need none."""
    pieces = pieces.sort_values("block", ignore_index=True)
    after, out = FINAL, []
    for costs in reversed(pieces["costs"].tolist()):
        out.append([int(c) for c in after])
        after = np.minimum((np.array(costs).reshape(4, 4) + after[None]).min(axis=1), INF)
    pieces["costs"] = out[::-1]
    pieces["last"] = pieces.index == len(pieces) - 1
    return pieces if len(pieces) > 1 else pieces.iloc[:0]


def least_paths(kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray, last: np.ndarray, variants: int) -> np.ndarray:
    """The edits of every row on the least of the cheapest paths from each of the first `variants` states.

    Pieces are consecutive rows; `ends` are the costs after each, `last` says that nothing follows, so that inserts may end it.
    """
    n, m = len(kinds), len(starts)
    layer = np.arange(n) + np.repeat(np.arange(m), lengths)  # a layer of four nodes before every row, and one at a piece's end
    end = starts + lengths + np.arange(m)
    costs = np.empty((n + m, 4), dtype=np.int64)
    costs[end] = ends
    for _, rows, c in _costs(kinds, starts, lengths, ends):
        costs[layer[rows]] = c
    # optimal arcs of the letters D, I, K, R: targets, -1 where the arc costs more than the node
    at = 4 * np.arange(n + m)[:, None]
    target = np.full((n + m, 4, 4), -1)
    inserted = np.where(costs[:, ADDED] + 5 == costs, at + ADDED, -1)
    closed = end[~last]
    inserted[closed] = -1  # inserts before the next piece are that piece's
    target[:, :, 1] = inserted
    down, after = 4 * (layer + 1)[:, None], costs[layer + 1]
    here = costs[layer]
    target[layer, :, 0] = np.where(after + 2 == here, down + np.arange(4), -1)
    kept = np.take_along_axis(after, _TO[kinds], 1) + _KEEP[kinds]
    target[layer, :, 2] = np.where(kept == here, down + _TO[kinds], -1)
    target[layer, :, 3] = np.where(after[:, ADDED] + _REROLE[kinds][:, None] == here, down + ADDED, -1)
    target = target.reshape(-1, 4)
    node = np.arange(len(target))
    optimal = target >= 0
    ended = ~optimal.any(axis=1)
    # ranks of the least audits of 1, 2, 4, ... letters, and the nodes they lead to
    rank = np.where(ended, 0, optimal.argmax(axis=1) + 1)
    doubled = [np.where(ended, node, target[node, optimal.argmax(axis=1)])]
    while not ended[doubled[-1]].all():
        pairs = rank * (int(rank.max()) + 1) + rank[doubled[-1]]
        rank = np.unique(pairs, return_inverse=True)[1]
        doubled.append(doubled[-1][doubled[-1]])
    # of a node's optimal arcs the one of least letter, then least rank of what follows
    ordered = np.where(optimal, np.arange(4) * len(target) + rank[np.maximum(target, 0)], 4 * len(target))
    code = np.where(ended, 0, ordered.argmin(axis=1) + 1)
    out = np.empty((variants, n), dtype=object)
    for v in range(variants):
        on = np.zeros(len(target), dtype=bool)
        on[4 * (starts + np.arange(m)) + v] = True
        for jump in doubled:  # every number of steps is a sum of powers of two
            on[jump[on]] = True
        inserts = (on & (code == 2)).reshape(-1, 4).sum(axis=1)
        letter = np.where(on & (code != 2), code, 0).reshape(-1, 4).max(axis=1)
        edits = np.char.add(np.char.multiply("I", inserts), LETTERS[letter]).astype(object)
        out[v] = edits[layer]
        out[v, starts + lengths - 1] += edits[end]
    return out


EDITS = "at long, edits array<string>, first boolean"
EMPTY = {"at": pa.array([], pa.int64()), "edits": pa.array([], pa.list_(pa.string())), "first": pa.array([], pa.bool_())}


def _edits(rows: pa.Table, following: pa.Table) -> pa.Table:
    """Per row of a block, its edits: one string, or for a piece of a cut conversation one for each state before the piece."""
    if not rows.num_rows:
        return pa.table({"conv": rows["conv"], **EMPTY})
    rows = rows.sort_by("at")
    conv, kinds = rows["conv"].combine_chunks(), rows["kind"].to_numpy()
    starts, lengths = _pieces(conv)
    ends, last, cut = np.tile(FINAL, (len(starts), 1)), np.ones(len(starts), dtype=bool), np.zeros(len(starts), dtype=bool)
    edge = {conv[int(starts[i])].as_py(): i for i in (0, len(starts) - 1)}
    for c, costs, final in zip(*(following[k].to_pylist() for k in ("conv", "costs", "last"))):
        i = edge[c]
        ends[i], last[i], cut[i] = costs, final, True
    edits = least_paths(kinds, starts, lengths, ends, last, 4 if cut.any() else 1)
    open_rows = np.repeat(cut, lengths)
    lists = [edits[:, i].tolist() if open_rows[i] else [edits[0, i]] for i in range(len(kinds))]
    first = np.zeros(len(kinds), dtype=bool)
    first[starts] = True
    return pa.table({"conv": conv, "at": rows["at"], "edits": pa.array(lists, pa.list_(pa.string())), "first": pa.array(first)})


OUT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class _Repair:
    """One conversation, row by row."""

    def __init__(self):
        self.state = self.variant = 0
        self.faults = [0, 0, 0, 0]
        self.illegal = self.cost = self.turns = 0
        self.initial = self.low = self.high = None
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.lines = 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def add(self, turn: int | None, role: str, text: str, fault: int, edits: list[str], first: bool) -> None:
        if first:
            self.variant = self.state if len(edits) > 1 else 0
        self.faults[fault] += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        for e in edits[self.variant]:
            self.audit.append(e)
            if e == "D":
                self.cost += 2
                continue
            self.cost += {"I": 5, "K": 0, "R": 1}[e] + 5 * (fault == 1 and e != "I")
            if e == "K":
                self.state = int(STEP[INITIALS.index(role[0])][self.state])
            else:
                self.state = int(ADDED[self.state])
            named = role if e == "K" else "user" if self.state == 2 else "assistant"
            self.line(named, "" if e == "I" else text)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        _, truncated, blank, duplicate = self.faults
        return (gaps, blank, duplicate, truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and number, each after its edits, to one result a conversation."""
    names = ["conv_id", *[c.split()[0] for c in OUT.split(", ")]]
    types = [*[pa.int64()] * 6, pa.string(), pa.string()]
    now, repair = None, None

    def ended() -> pa.RecordBatch:
        results = [pa.array([x], t) for x, t in zip(repair.result(), types)]
        return pa.RecordBatch.from_arrays([pa.array([now.as_py()], now.type), *results], names=names)

    for batch in batches:
        done = []
        for conv, *values in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])):
            if repair is None or conv.as_py() != now.as_py():
                if repair is not None:
                    done.append(ended())
                now, repair = conv, _Repair()
            turn, role, text, fault, dropped, listed, first = values
            if listed is not None:
                edits = listed, first
            elif not dropped:
                repair.add(turn, role, text, fault, *edits)
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if repair is not None:
        yield ended()


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Damage and repair every conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    t = faulted(rows, block_rows)
    kind = t.schema["conv"].dataType.simpleString()
    slim = t.filter(F.col("kind") != NO_ROW).select("conv", "at", "block", "kind")
    pieces = slim.groupBy("block").applyInArrow(_edges, f"conv {kind}, {EDGES}")
    cut = pieces.groupBy("conv").applyInPandas(_following, f"conv {kind}, {EDGES}, last boolean")
    edits = slim.groupBy("block").cogroup(cut.groupBy("block")).applyInArrow(_edits, f"conv {kind}, {EDITS}")
    columns = ["conv", "turn", "role", "text", "fault", "dropped", "edits", "first"]
    both = t.select("at", *columns[:-2]).unionByName(edits, allowMissingColumns=True)
    ordered = both.repartition("conv").sortWithinPartitions("conv", "at", F.col("edits").isNull())
    return stage_text(ordered.select(*columns).mapInArrow(_stream, f"conv_id {kind}, {OUT}"), "repaired")
