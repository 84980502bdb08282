"""Repair of conversation structure by scalar big-integer weights.

``damage`` plants faults in stored conversations, ``repair`` finds and mends them. A conversation's
rows are taken by turn; each row's first fault counts (blank, duplicate, truncated). The cheapest
edits that give the roles ``(s?(ua)+)?`` are a path in a graph whose nodes are rows and states of
that form. A path's weight is one integer: its high digits are the cost, and below them the audit
letters stand from the left in a fixed number of places, an earlier letter in a higher place, empty
places zero. The ordinary minimum of integers at each node therefore decides the cost first and
then the least audit text; nothing else decides.

Two paths of equal cost through the same rows are never one the beginning of the other, since
the longer one would have paid for its further insertions; so at a node their order is final. Nor
are any two paths that end with a row's edit, since both have a letter for each row. So after
``BLOCK`` rows the letters so far may be replaced by one digit, the rank of the state's path among
those of all states: integers stay short in a conversation of any length. Twice in a row nothing is
ever inserted: without the two rows the state is the same, or the opening system row can be
deleted for less.

Each state carries a hash of its repaired text, so texts are not held: a task sorts its
conversations (Spark spills), reads them once and keeps some 24 bytes a row of the one at hand.
One conversation is read by one task, because its result is one hash over all its rows in order.

Defined cases: a null conversation id is one conversation; null roles and texts are one space, a
null id or turn is one space where rows are damaged; rows of the same turn are taken by role, then
by text, and repeated rows are rows; a role counts by its first letter, an empty one fits nowhere;
an empty table gives no rows; other columns are left out; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annalist.llm import common

# A text without a word, and one that ends a sentence.
BLANK, WHOLE = "^[\\x20\\x09-\\x0D]*\\z", "[.!?][\\x20\\x09-\\x0D]*\\z"

# Letters of an audit in ASCII order; their digits start at one, zero is the end.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(1, 5)
DIGIT_BITS = 3

COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED_COST = 3

# States of the form: nothing yet, after the system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
# The state that a user's or an assistant's row leads to, by the state before.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}

# Rows after which the letters of all paths are replaced by their ranks.
BLOCK = 32
# Places for letters: an insertion and an edit for each row of a block, one insertion more at the
# end, and the rank in front.
PLACES = 2 * BLOCK + 2
PLACE = [DIGIT_BITS * (PLACES - 1 - k) for k in range(PLACES)]
HIGH = DIGIT_BITS * PLACES


def damage(rows: DataFrame) -> DataFrame:
    """Rows with a fault by the crc32 of ``conv_id:turn``; dropped rows stay, marked ``gone``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = text_of("text")
    return (
        rows.select("conv_id", "turn", text_of("role").alias("role"), text.alias("text"), fault.alias("fault"))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fault") == 0, "").when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fault") <= 1, "")
            .when(F.col("fault") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            (F.col("fault") == 0).alias("gone"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


class Seen:
    """A set of 128-bit digests in 16 bytes each: sorted runs of doubling length, and the latest ones."""

    LATEST = 20_000

    def __init__(self):
        self.latest: set[bytes] = set()
        self.runs: list[np.ndarray] = []

    def add(self, digest: bytes) -> bool:
        """Whether the digest was there before."""
        if digest in self.latest or any(self._in(run, digest) for run in self.runs):
            return True
        self.latest.add(digest)
        if len(self.latest) >= self.LATEST:
            run = np.sort(np.array([(int.from_bytes(x[:8]), int.from_bytes(x[8:])) for x in self.latest], "u8,u8"))
            while self.runs and len(self.runs[-1]) <= len(run):
                run = np.sort(np.concatenate([self.runs.pop(), run]))
            self.runs.append(run)
            self.latest = set()
        return False

    @staticmethod
    def _in(run: np.ndarray, digest: bytes) -> bool:
        high, low = int.from_bytes(digest[:8]), int.from_bytes(digest[8:])
        start = np.searchsorted(run["f0"], np.uint64(high))
        while start < len(run) and run["f0"][start] == high:
            if run["f1"][start] == low:
                return True
            start += 1
        return False


class Path:
    """The best path to a state: its weight, its letters in this block, its text's hash."""

    __slots__ = ("weight", "letters", "hash", "empty")

    def __init__(self, weight: int, letters: int, hash_, empty: bool):
        self.weight, self.letters, self.hash, self.empty = weight, letters, hash_, empty

    def step(self, letter: int, extra: int = 0) -> int:
        """The weight with one more edit."""
        return self.weight + ((COST[letter] + extra) << HIGH) + (letter << PLACE[self.letters])


class Repair:
    """One conversation, row by row."""

    def __init__(self):
        self.paths: dict[int, Path] = {START: Path(0, 1, hashlib.sha256(), True)}
        # For each edit in turn, by state: the letter and the state before; both fit in a byte.
        self.back: list[bytearray] = [bytearray() for _ in range(4)]
        self.in_block = 0
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.turn = None
        self.turns = 0
        self.before: str | None = None
        self.seen = Seen()

    def add(self, turn: int | None, role: str, text: str, blank: bool, whole: bool) -> None:
        self.rows += 1
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
            self.turns += 1
        first = role[:1]
        if self.before is not None and self.before + first not in LEGAL:
            self.illegal += 1
        self.before = first
        # The length in front keeps role and text apart.
        again = self.seen.add(hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest())
        extra, required = 0, blank or again
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif not whole:
            self.truncated += 1
            extra = TRUNCATED_COST
        self._insert()
        steps: list[tuple[int, int, int, int, str | None]] = []
        for state, path in self.paths.items():
            steps.append((state, path.step(DELETE), state, DELETE, None))
            if required:
                continue
            then = SYSTEM if first == "s" and state == START else NEXT[state]
            if first == ("s", "u", "a")[then - 1]:
                steps.append((then, path.step(KEEP, extra), state, KEEP, role))
            steps.append((NEXT[state], path.step(REROLE, extra), state, REROLE, ROLES[NEXT[state]]))
        self._take(steps, text)
        self.in_block += 1
        if self.in_block == BLOCK:
            self._rank()

    def _insert(self) -> None:
        """One row more, or none, in front of what comes."""
        steps = [(state, path.weight, state, 0, None) for state, path in self.paths.items()]
        steps += [(NEXT[state], path.step(INSERT), state, INSERT, ROLES[NEXT[state]]) for state, path in self.paths.items()]
        self._take(steps, "")

    def _take(self, steps: list[tuple[int, int, int, int, str | None]], text: str) -> None:
        best: dict[int, tuple[int, int, int, int, str | None]] = {}
        for step in steps:
            if step[0] not in best or step[1] < best[step[0]][1]:
                best[step[0]] = step
        paths = {}
        for state, (_, weight, source, letter, role) in best.items():
            old = self.paths[source]
            if role is None:
                paths[state] = Path(weight, old.letters + (letter > 0), old.hash, old.empty)
            else:
                own = old.hash.copy()
                own.update((("" if old.empty else "\n") + role + ":" + text).encode())
                paths[state] = Path(weight, old.letters + 1, own, False)
        for state in range(4):
            self.back[state].append(best[state][3] << 2 | best[state][2] if state in best else 0)
        self.paths = paths

    def _rank(self) -> None:
        """Start a new block: the letters of the one behind become one digit."""
        order = sorted(self.paths, key=lambda s: self.paths[s].weight & ((1 << HIGH) - 1))
        for rank, state in enumerate(order):
            path = self.paths[state]
            path.weight = (path.weight >> HIGH << HIGH) + (rank + 1 << PLACE[0])
            path.letters = 1
        self.in_block = 0

    def result(self) -> tuple:
        if not self.rows:
            return 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()
        self._insert()
        state = min((s for s in self.paths if s in (START, ASSISTANT)), key=lambda s: self.paths[s].weight)
        path = self.paths[state]
        letters = bytearray()
        for k in range(len(self.back[0]) - 1, -1, -1):
            code = self.back[state][k]
            if code >> 2:
                letters.append(ord(LETTERS[(code >> 2) - 1]))
            state = code & 3
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (
            gaps, self.blank, self.duplicate, self.truncated, self.illegal,
            path.weight >> HIGH, letters[::-1].decode(), path.hash.hexdigest(),
        )


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the repaired text's hash of every conversation.

    ``rows`` has ``conv_id, turn, role, text``, and ``gone`` where rows only say that there was a
    conversation. One shuffle, by conversation.
    """
    common.ship(rows.sparkSession)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    source = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        gone.alias("gone"),
    )
    kind = source.schema["conv_id"].dataType.simpleString()
    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    # The faults that one row shows by itself are found by Spark's own functions, after the shuffle.
    told = dealt.withColumns({"blank": F.col("text").rlike(BLANK), "whole": F.col("text").rlike(WHOLE)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIGURES.split(", ")]
        schema = None
        now, at = None, None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids = pa.array([x[0] for x in done], schema.field("conv_id").type)
            out = [ids, *(pa.array(list(c)) for c in list(zip(*(x[1:] for x in done))))]
            done.clear()
            return pa.RecordBatch.from_arrays(out, ["conv_id", *names])

        for batch in common.slices(batches):
            schema = batch.schema
            columns = [batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "gone", "blank", "whole")]
            for conv, turn, role, text, away, blank, whole in zip(*columns):
                if now is None or conv != at:
                    if now is not None:
                        done.append((at, *now.result()))
                    now, at = Repair(), conv
                if not away:
                    now.add(turn, role, text, blank, whole)
            if done:
                yield flush()
        if now is not None:
            done.append((at, *now.result()))
            yield flush()

    return told.mapInArrow(run, f"conv_id {kind}, {FIGURES}")
