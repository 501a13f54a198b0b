"""Conversation structure repair by a generalised LR parse with weighted edits.

The grammar of a conversation's role initials is `(s?(ua)+)?`. Its LR automaton has four stack tops: nothing yet, after s,
after u, after a; the first and the last may end. Every row is read with all edits open: keep it (0; its initial must
shift), rerole it as a user or assistant turn (3), delete it (4), and before it or at the end insert empty user or
assistant turns (3 each); a truncated row that stays costs 3 more, blank and repeated rows must go. The stacks of all
readings share their past as a graph: a node holds the way it was reached, and readings with equal tops merge to the one
of minimum (cost, audit), audit being the edits' initials in order. Merging is exact: two readings of the same rows with
equal cost are never prefixes of each other, for further letters would be inserts, which cost. A top that costs over 7 more
than another is given up: from any top the other's future can be followed with at most a deletion and an insert more. What
all tops have in common is settled and leaves the graph, so that memory follows the stretch in doubt, not the conversation.

A row's first fault counts: blank (no character other than white space), duplicate (role and text seen earlier in the
conversation), truncated (its last such character is none of `.!?`). Null roles and texts read as one space; an empty
role has no initial and cannot be kept. Rows go by turn, nulls first, ties by role, then text; a null conv_id is a
conversation. No rows: no result. Extra columns are ignored. Rows with ``held`` false only name their conversation.

One shuffle deals rows by conversation; Spark sorts and spills, and a task reads its conversations as a stream. A hot
conversation is read by one task, since the digest of its repaired rows is one sequential SHA-256; nothing of it is
gathered but its audit, one letter a row.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, only, table

# The edits' costs, the tops each role initial shifts (from: to), and the tops that may end.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
SHIFT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
ENDS = (START, AFTER_A)
ROLE = {"u": "user", "a": "assistant"}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = ("su", "ua", "au")
SETTLE = 64

# A node of the graph: cost, audit since the last settling, and the way to it as (earlier way, letter, row or None).
Node = tuple[int, str, tuple | None]
Edit = tuple[str, tuple | None]


class Repair:
    """Parse of one conversation: ``push`` its rows in order; both return the edits settled by now, as (letter, (role, text) or
    None for a deleted row)."""

    def __init__(self):
        self.tops: dict[int, Node] = {START: (0, "", None)}
        self.cost, self.settled, self.due = 0, 0, SETTLE

    @staticmethod
    def _merge(tops: dict[int, Node], top: int, node: Node) -> bool:
        if top not in tops or node[:2] < tops[top][:2]:
            tops[top] = node
            return True
        return False

    def _inserted(self) -> dict[int, Node]:
        """The tops with all inserts that lead to a cheaper or new one."""
        tops, open_ = dict(self.tops), list(self.tops)
        while open_:
            top = open_.pop(0)
            cost, audit, way = tops[top]
            for initial, role in ROLE.items():
                to = SHIFT[initial].get(top)
                if to is not None and self._merge(tops, to, (cost + INSERT, audit + "I", (way, "I", (role, "")))):
                    open_.append(to)
        return tops

    def push(self, role: str, text: str, fault: int) -> list[Edit]:
        tops: dict[int, Node] = {}
        more = CUT if fault == TRUNCATED else 0
        for top, (cost, audit, way) in self._inserted().items():
            self._merge(tops, top, (cost + DELETE, audit + "D", (way, "D", None)))
            if fault in (BLANK, DUPLICATE):
                continue
            to = SHIFT.get(role[:1], {}).get(top)
            if to is not None:
                self._merge(tops, to, (cost + KEEP + more, audit + "K", (way, "K", (role, text))))
            for initial, name in ROLE.items():
                to = SHIFT[initial].get(top)
                if to is not None:
                    self._merge(tops, to, (cost + REROLE + more, audit + "R", (way, "R", (name, text))))
        most = min(n[0] for n in tops.values()) + DELETE + INSERT
        self.tops = {t: n for t, n in tops.items() if n[0] <= most}
        self.due -= 1
        return self._settle() if self.due <= 0 else []

    def _settle(self) -> list[Edit]:
        n = len(os.path.commonprefix([audit for _, audit, _ in self.tops.values()]))
        done: list[Edit] = []
        for top, (cost, audit, way) in self.tops.items():
            edits = _walked(way)
            done, way = edits[:n], None
            for letter, row in edits[n:]:
                way = (way, letter, row)
            self.tops[top] = (cost, audit[n:], way)
        self.due = SETTLE + 2 * max(len(audit) for _, audit, _ in self.tops.values())
        return done

    def finish(self) -> list[Edit]:
        cost, _, way = min((n for t, n in self._inserted().items() if t in ENDS), key=lambda n: n[:2])
        self.cost = cost
        return _walked(way)


def _walked(way: tuple | None) -> list[Edit]:
    edits = []
    while way is not None:
        way, letter, row = way
        edits.append((letter, row))
    return edits[::-1]


class Report:
    """Counts, audit and digest of one conversation; takes rows in order."""

    def __init__(self, conv: int | None):
        self.conv, self.repair, self.sha, self.audit = conv, Repair(), hashlib.sha256(), []
        self.faults, self.illegal, self.turns, self.gap, self.before, self.any = [0] * 4, 0, None, 0, None, False

    def push(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.gap += max(turn - self.turns - 1, 0) if self.turns is not None else 0
            self.turns = turn
        self._take(self.repair.push(role, text, fault))

    def _take(self, edits: list[Edit]) -> None:
        for letter, row in edits:
            self.audit.append(letter)
            if row is not None:
                self.sha.update(f"{chr(10) if self.any else ''}{row[0]}:{row[1]}".encode())
                self.any = True

    def finish(self) -> tuple:
        self._take(self.repair.finish())
        counts = (self.gap, *self.faults[1:], self.illegal, self.repair.cost)
        return self.conv, *counts, "".join(self.audit), self.sha.hexdigest()


class Rows(Report):
    """The repaired rows of one conversation instead of its report."""

    def __init__(self, conv: int | None):
        super().__init__(conv)
        self.place, self.out = 0, []

    def _take(self, edits: list[Edit]) -> None:
        for letter, row in edits:
            if row is not None:
                self.out.append((self.conv, self.place, letter, *row))
                self.place += 1

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _reader(kind: type, names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for frame in frames:
            convs, turns = (frame[c].astype("Int64").tolist() for c in ("conv_id", "turn"))
            for conv, turn, role, text, fault, held in zip(convs, turns, *(frame[c] for c in ("role", "text", "fault", "held")), strict=True):
                conv = None if conv is pd.NA else int(conv)
                if now is None or now.conv != conv:
                    if now is not None:
                        end = now.finish()
                        out += now.taken() if kind is Rows else [end]
                    now = kind(conv)
                if held:
                    now.push(None if turn is pd.NA else int(turn), role, text, fault)
            if kind is Rows and now is not None:
                out += now.taken()
            yield _frame(out, names)
            out = []
        if now is not None:
            end = now.finish()
            yield _frame(now.taken() if kind is Rows else [end], names)

    return read


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({names[0]: "Int64"})


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, held, each conversation whole and in order in one partition."""
    rows = only(rows, "conv_id", "turn", "role", "text", *(["held"] if "held" in rows.columns else []))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    held = F.col("held") if "held" in rows.columns else F.lit(True)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), held.alias("held"))
    rows = rows.repartition("conv_id")
    # Partitioned by conversation already: the window asks for no second shuffle.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "held").orderBy(F.asc_nulls_first("turn")))
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK).when(seen > 1, DUPLICATE)
        .when(~F.rtrim(F.translate("text", "\x09\x0a\x0b\x0c\x0d", "     ")).rlike("[.!?]$"), TRUNCATED).otherwise(NONE)
    )
    rows = rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), "held", seen.alias("seen"))
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen").drop("seen")


def reported(rows: DataFrame) -> DataFrame:
    """One row per conversation: its gaps, faults, illegal neighbours, least cost, audit and digest of the repaired rows."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [f"{n} {'string' if n in names[7:] else 'bigint'}" for n in names]
    return ordered(rows).mapInPandas(_reader(Report, names), ", ".join(kinds))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place from 0, edit (K, R or I), role, text."""
    names = ["conv_id", "place", "edit", "role", "text"]
    return ordered(rows).mapInPandas(_reader(Rows, names), "conv_id bigint, place bigint, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """The query's rows: by the remainder of a key's checksum a row is dropped (held false), emptied, stripped of its sentence
    ends, repeated, or given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text, h = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.crc32(key) % 20
    rows = only(rows, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(h == 0, F.array(F.lit(False))).when(h == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True))).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("held"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(damaged(table(spark, sf_dir, "conversations")))
