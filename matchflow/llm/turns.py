"""Repair of conversations by aligning their turns to a grammar of roles.

A conversation should read s?(ua)+ in the initials of its roles (an empty one is fine, too). For
each length that can be the cheapest there is one target string, and Wagner-Fischer's table aligns
the turns to it: keep, delete, insert, or give a turn another role. The cheapest repair found so
far is the incumbent: it rules out lengths, and bands each table to the diagonals whose least
cost (Ukkonen) isn't above it. Repairs of equal cost are compared by their audits, traced back.

Long conversations are aligned in blocks of turns, from each state that the grammar can be in (at
the start, after a system, user or assistant turn) to each it can be in behind the block; the
states' best repairs, running hashes among them, go on to the next block. An insertion belongs to
the turn behind it, so that no block's audit is the start of another's and the least of the
whole is made of the least of the parts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import map_batches

#: Turns aligned at a time.
BLOCK = 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# States of the grammar: nothing yet, behind the system's turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"


def target(state: int, length: int, system: bool = False) -> str:
    """The initials that may follow in a state, ``length`` of them."""
    if system:
        return "s" + target(SYSTEM, length - 1)
    first = "au" if state == USER else "ua"
    return (first * (length // 2 + 1))[:length]


def _behind(state: int, initials: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initials[-1]] if initials else state


def wagner_fischer(turns: str, want: str, bound: int, last: bool) -> tuple[int, str] | None:
    """Cost and ASCII-least audit of the cheapest edits of ``turns`` to the initials ``want``, if
    not above ``bound``. ``turns`` has two characters for each turn: its role's initial, and what
    is wrong: '-' nothing, 't' truncated, 'x' to be deleted. Insertions behind the last turn
    only if ``last``."""
    n, m = len(turns) // 2, len(want)
    shift = m - n
    fits = lambda k: max(INSERT * k, -DELETE * k) + max(INSERT * (shift - k), -DELETE * (shift - k)) <= bound
    low, high = min(0, shift), max(0, shift)  # a diagonal between them costs what the shift costs
    if not fits(low):
        return None
    while fits(low - 1):
        low -= 1
    while fits(high + 1):
        high += 1
    # rest[i][j - i - low]: least cost of turning turns[i:] into want[j:]
    width, top = high - low + 1, math.inf
    rest = [[top] * (width + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row = rest[i]
        if i < n:
            initial, fault = turns[2 * i], turns[2 * i + 1]
            extra = TRUNCATED if fault == "t" else 0
            below = rest[i + 1]
        for k in range(min(high, m - i), max(low, -i) - 1, -1):
            j, at = i + k, k - low
            if i == n:
                row[at] = 0 if j == m else row[at + 1] + INSERT if last else top
                continue
            best = row[at + 1] + INSERT if j < m else top
            if at and below[at - 1] + DELETE < best:
                best = below[at - 1] + DELETE
            if j < m and fault != "x":
                if initial == want[j]:
                    c = below[at] + extra
                elif want[j] in ROLES:
                    c = below[at] + extra + REROLE
                else:
                    c = top
                if c < best:
                    best = c
            row[at] = best
    total = rest[0][-low]
    if total > bound:
        return None
    # Traced from the front, taking the least letter among the cheapest: D, I, K, R.
    audit, i, j = [], 0, 0
    while i < n or j < m:
        at, here = j - i - low, rest[i][j - i - low]
        if i < n and at and rest[i + 1][at - 1] + DELETE == here:
            audit.append("D")
            i += 1
        elif j < m and rest[i][at + 1] + INSERT == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[2 * i] == want[j] else "R")
            i += 1
            j += 1
    return total, "".join(audit)


@lru_cache(maxsize=1 << 15)
def align(turns: str, state: int, last: bool) -> dict[int, tuple[int, str, str]]:
    """The cheapest edits of a block of turns from a state of the grammar, for each state behind
    them: (cost, audit, initials). Behind the last block only accepting states count."""
    n = len(turns) // 2
    forced = turns[1::2].count("x")
    live = n - forced
    system = state == START and any(turns[i] == "s" and turns[i + 1] != "x" for i in range(0, 2 * n, 2))
    found: dict[int, tuple[int, str, str]] = {}

    def least(m: int) -> int:
        return DELETE * max(forced, n - m) + INSERT * max(0, m - live)

    # Lengths by their least cost: a state's are done when that is above its incumbent.
    for opened in (False, True) if system else (False,):
        for m in sorted(range(1 if opened else 0, 2 * n + 8), key=lambda m: (least(m), m)):
            want = target(state, m, opened)
            end = _behind(state, want)
            if last and end not in ACCEPTING:
                continue
            bound = found[end][0] if end in found else DELETE * n + INSERT * m + n
            if least(m) > bound:
                continue
            got = wagner_fischer(turns, want, bound, last)
            if got and (end not in found or got < found[end][:2]):
                found[end] = (*got, want)
    return found


class Repair:
    """The repair of one conversation, block by block: for each state of the grammar the cheapest
    way there, with its audit and the hash of its repaired lines."""

    def __init__(self):
        self.ways = {START: (0, "", hashlib.sha256(), False)}
        self.codes: list[str] = []
        self.lines: list[tuple[str, str]] = []

    def add(self, role: str, text: str, fault: str) -> None:
        if len(self.codes) == BLOCK:
            self._block(False)
        self.codes.append((role[:1] or "-") + fault)
        self.lines.append((role, text))

    def _block(self, last: bool) -> None:
        turns = "".join(self.codes)
        best: dict[int, tuple] = {}
        for state, (cost, audit, _, _) in self.ways.items():
            for end, (more, edits, want) in align(turns, state, last).items():
                if end not in best or (cost + more, audit, edits) < best[end][:3]:
                    best[end] = (cost + more, audit, edits, state, want)
        ways = {}
        for end, (cost, audit, edits, state, want) in best.items():
            digest, any_line = self.ways[state][2].copy(), self.ways[state][3]
            for line in self._repaired(edits, want):
                digest.update(("\n" + line if any_line else line).encode())
                any_line = True
            ways[end] = (cost, audit + edits, digest, any_line)
        self.ways, self.codes, self.lines = ways, [], []

    def _repaired(self, edits: str, want: str) -> Iterator[str]:
        i = j = 0
        for e in edits:
            role, text = self.lines[i] if i < len(self.lines) else ("", "")
            if e == "K":
                yield f"{role}:{text}"
            elif e == "R":
                yield f"{ROLES[want[j]]}:{text}"
            elif e == "I":
                yield f"{ROLES[want[j]]}:"
            i += e != "I"
            j += e != "D"

    def done(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired turns)."""
        self._block(True)
        cost, audit, digest, _ = min(self.ways.values(), key=lambda w: w[:2])
        return cost, audit, digest.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of conversations with faults put in by a hash of place: rows lost,
    emptied, without their stops, repeated, or all the user's. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return out.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                      F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                      F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _place(turn: str) -> Column:
    """Turns in order, nulls first."""
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256):
    a row for each conversation.

    Turns go by ``turn_col``, nulls first, equal ones by role and text. A null role or text is
    one space. A turn's first fault counts: no visible character (blank), role and text of an
    earlier turn (duplicate), last visible character no stop (truncated). A null id is a
    conversation like any other; an empty table gives no rows; other columns are not read.

    Which turns repeat is found by an aggregate over (conversation, role, hash of the text), so that
    no task remembers a conversation's turns. Then each conversation is read in order by one
    task, as its hash asks, which keeps one block of turns and, for each state of the grammar, an
    audit and a running hash; Spark sorts on disk what doesn't fit."""
    kind = rows.schema[conv_col].dataType.simpleString()
    turn = rows.schema[turn_col].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    base = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), text(role_col).alias("r"), text(text_col).alias("x")) \
        .withColumn("h", F.sha2("x", 256))
    again = base.groupBy("c", "r", "h").agg(F.min(_place("t")).alias("first"), F.max(_place("t")).alias("final")) \
        .where("first <> final").select(F.col("c").alias("_c"), F.col("r").alias("_r"), F.col("h").alias("_h"), "first")
    same = F.col("c").eqNullSafe(F.col("_c")) & (F.col("r") == F.col("_r")) & (F.col("h") == F.col("_h"))
    marked = base.join(again, same, "left").select("c", "t", "r", "x", F.coalesce(_place("t") > F.col("first"), F.lit(False)).alias("again"))
    ordered = marked.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    schema = (f"c {kind}, n_turns long, low {turn}, high {turn}, n_places long, blank long, duplicate long, truncated long, illegal long, "
              "cost long, audit string, repaired_sha256 string")

    def run(batches):
        now = None  # of the conversation being read: [id, counts...]
        rows_out: list[tuple] = []

        def close():
            rows_out.append((*now[:9], *now[9].done()))

        types = None
        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(1).type]
            for c, t, r, x, repeats in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or c != now[0]:
                    if now is not None:
                        close()
                    now = [c, 0, None, None, 0, 0, 0, 0, 0, Repair()]
                    before = None
                visible = x.rstrip(SPACE)
                if not visible:
                    fault = "x"
                    now[5] += 1
                elif repeats or before == (t, r, x):
                    fault = "x"
                    now[6] += 1
                elif visible[-1] not in ".!?":
                    fault = "t"
                    now[7] += 1
                else:
                    fault = "-"
                now[1] += 1
                if t is not None:
                    now[4] += now[3] is None or t != now[3]
                    now[2], now[3] = t if now[2] is None else now[2], t
                if before is not None and before[1][:1] + r[:1] not in ("su", "ua", "au"):
                    now[8] += 1
                now[9].add(r, x, fault)
                before = (t, r, x)
            while len(rows_out) >= 1024:
                yield _batch(rows_out[:1024], types)
                del rows_out[:1024]
        if now is not None:
            close()
        if rows_out:
            yield _batch(rows_out, types)

    def _batch(some, types):
        kinds = [types[0], pa.int64(), types[1], types[1], *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ["c", "n_turns", "low", "high", "n_places", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    out = map_batches(ordered, run, schema)
    gaps = F.coalesce(F.col("high").cast("long") - F.col("low").cast("long") + 1 - F.col("n_places"), F.lit(0).cast("long"))
    return out.select(F.col("c").alias(conv_col), "n_turns", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The repair of the damaged conversations, a row for every id there was: one that lost all
    its turns has zeros, an empty audit and the hash of the empty text."""
    fixed = repair(damage(conversations)).withColumnRenamed("conv_id", "_id")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(fixed, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"), zero("n_turns"))
