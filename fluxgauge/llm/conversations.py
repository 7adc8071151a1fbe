"""Conversation structure repair: the cheapest edits that make the roles alternate, by A* on the edit lattice.

A row is blank (nothing but white space), else duplicate (its role and text came earlier in the conversation), else
truncated (its last character that is no white space is none of `.!?`), else sound. Rows are kept (0), given the role
user or assistant (2) or deleted (3; blank and duplicate ones must be), and empty user or assistant rows are
inserted (2); a truncated row that stays costs 1. The roles' initials must then be nothing, or user and assistant in
turn, perhaps after one system row. A node of the lattice is a number of rows passed and a state of that pattern.
The heuristic is the suffix sum of what no path avoids: 3 for each mandatory deletion, 1 for each truncated row. Nodes
leave the queue by cost plus heuristic, then by the audit (the edits' initials so far), so that the first goal is the
cheapest and of those the one with the least audit.

Rows are shuffled once, by conversation, and sorted by turn (null first), role and text. A conversation streams
through its task: after every SEGMENT rows the search keeps one path for each of the four states, drops the states that
another one beats whatever follows, and commits the edits that all paths share, so texts are held only until they are
committed. What grows with a conversation in its task is a letter of audit and sixteen bytes of digest for each row.

Null roles and texts count as one space; a null id is a conversation of its own; null turns come first and make no
gap. Rows with equal turns are in the order of role and text; repeated rows are duplicates. A conversation without rows
(all marked as dropped) has zeros, an empty audit and the empty text's digest. An empty table has no rows. Texts of
any length are read whole. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, utf8

KEEP, RENAME, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
SEGMENT = 64
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system row, after a user row, after an assistant row; where initials lead, and what is wanted next.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WANTED = ("user", "user", "assistant", "user")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

Row = tuple[str, str, bool, bool]  # role, text, must be deleted, truncated
Path = tuple[int, str]  # cost, audit


def search(rows: list[Row], paths: dict[int, Path], last: bool) -> dict[int, Path]:
    """From the paths to the states before these rows, the best path to each state behind them; with last, to a complete one alone."""
    rest = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][2] else CUT if rows[i][3] else 0)
    queue = [(cost + rest[0], audit, 0, state, cost) for state, (cost, audit) in paths.items()]
    heapq.heapify(queue)
    done, found = set(), {}
    while queue:
        _, audit, i, state, cost = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows):
            if not last:
                found[state] = (cost, audit)
            elif state in (START, ASSISTANT):
                return {state: (cost, audit)}
        into = LEADS[state][WANTED[state][0]]
        steps = [(INSERT, "I", 0, into)]
        if i < len(rows):
            role, _, must, cut = rows[i]
            steps.append((DELETE, "D", 1, state))
            if not must:
                steps.append((RENAME + CUT * cut, "R", 1, into))
                if (kept := LEADS[state].get(role[:1])) is not None:
                    steps.append((KEEP + CUT * cut, "K", 1, kept))
        for price, letter, on, to in steps:
            if (i + on, to) not in done:
                heapq.heappush(queue, (cost + price + rest[i + on], audit + letter, i + on, to, cost + price))
    return found


class Repair:
    """One conversation's rows, in order; say() gets role, text and edit of each repaired row as soon as it is certain."""

    def __init__(self, say: Callable[[str, str, str], None], segment: int = SEGMENT):
        self.say, self.segment = say, segment
        self.paths: dict[int, Path] = {START: (0, "")}
        self.rows: list[Row] = []  # passed by the search, but not yet committed
        self.next: list[Row] = []
        self.seen: set[bytes] = set()
        self.state, self.audit = START, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.before: str | None = None
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.before is not None and (self.before, role[:1]) not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        raw = utf8(role)
        digest = hashlib.blake2b(b"%d %b %b" % (len(raw), raw, utf8(text)), digest_size=16).digest()
        bare = text.strip(SPACE)
        blank, again = not bare, digest in self.seen
        self.seen.add(digest)
        cut = not blank and not again and bare[-1] not in ".!?"
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut
        self.next.append((role, text, blank or again, cut))
        if len(self.next) == self.segment:
            self._search(False)

    def _search(self, last: bool) -> None:
        found = search(self.next, self.paths, last)
        if not last and (whole := found.get(ASSISTANT)) is not None:
            # Whatever follows a lone system row may follow a whole turn; what follows nothing may, but for a system row that then goes.
            if SYSTEM in found and whole[0] < found[SYSTEM][0]:
                del found[SYSTEM]
            if START in found and whole[0] + DELETE < found[START][0]:
                del found[START]
        self.rows += self.next
        self.next = []
        sure = commonprefix([audit for _, audit in found.values()])
        self.paths = {s: (cost, audit[len(sure) :]) for s, (cost, audit) in found.items()}
        at = 0
        for letter in sure:
            if letter == "I":
                role, text = WANTED[self.state], ""
            else:
                role, text, *_ = self.rows[at]
                at += 1
                if letter == "D":
                    continue
                if letter == "R":
                    role = WANTED[self.state]
            self.state = LEADS[self.state][role[:1]]
            self.say(role, text, letter)
        del self.rows[:at]
        self.audit.append(sure)

    def end(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        self._search(True)
        ((cost, _),) = self.paths.values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows with faults put in by their key's CRC-32; copies is 0 for a dropped row, 2 for a repeated one."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(spaced[3], ".!?", "")).otherwise(spaced[3])
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(spaced[2]).alias("role"), text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _dealt(rows: DataFrame, copies: Column) -> DataFrame:
    """Whole conversations in one partition each, in order."""
    prepare(rows.sparkSession)
    some = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    picked = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *some, copies.cast("int").alias("copies"))
    return picked.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _stream(batches: Iterator[pa.RecordBatch], begin: Callable[[object], Callable], ended: Callable[[object, tuple], None]) -> Iterator[None]:
    """Pass conversations through Repair; begin(id) gives say() of a conversation; yields after each batch and at the end."""
    key, now = None, None
    for batch in batches:
        for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != key:
                if now is not None:
                    ended(key, now.end())
                key, now = conv, Repair(begin(conv))
            for _ in range(copies):
                now.add(turn, role, text)
        yield
    if now is not None:
        ended(key, now.end())
    yield


def repaired(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, place (from 0), role, text, edit: the repaired conversations of rows (conv_id, turn, role, text)."""
    dealt = _dealt(rows, F.lit(1) if copies is None else copies)
    kind = dealt.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def begin(conv):
            place = iter(range(1 << 62))
            return lambda role, text, edit: out.append((conv, next(place), role, text, edit))

        id_type = None

        def noted():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("conv_id").type
                yield b

        for _ in _stream(noted(), begin, lambda *_: None):
            if out:
                columns = zip(*out, strict=True)
                kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "role", "text", "edit"])
                out.clear()

    return dealt.mapInArrow(run, f"conv_id {kind}, place bigint, role string, text string, edit string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows (conv_id, turn, role, text)."""
    dealt = _dealt(rows, F.lit(1) if copies is None else copies)
    kind = dealt.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        digest = hashlib.sha256()
        id_type = None

        def begin(conv):
            nonlocal digest
            digest, gap = hashlib.sha256(), [b""]

            def say(role: str, text: str, edit: str) -> None:
                digest.update(gap[0] + utf8(role) + b":" + utf8(text))
                gap[0] = b"\n"

            return say

        def noted():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("conv_id").type
                yield b

        for _ in _stream(noted(), begin, lambda conv, found: out.append((conv, *found, digest.hexdigest()))):
            if out:
                kinds = (id_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string())
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])
                out.clear()

    return dealt.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string")
