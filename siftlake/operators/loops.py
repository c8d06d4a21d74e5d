"""Replay of a lane's conversation under each of the loop modes.

    none     the first turn alone
    trace    follow-up turns that complete traces
    reflect  follow-up turns that complete traces and add findings
    gap      follow-up turns that add findings
    sweep    a conversation of its own for each group of the lane's classes

The first turn's findings stand as they came. A follow-up turn is folded into what is known; `passes` bounds
their number, and the first one that adds and revises nothing is the last. A turn without findings is such a turn. In sweep,
turn k is the conversation about class group k: of its findings only the group's classes count, those without one of
them go, and what is left is folded into what is known; every group is asked, whatever the others yield. A gap turn is asked for
new findings alone, so one that is like a known finding changes nothing, unless `gap_revises`.

Findings are those of operators/findings.py, with turn 0 first; lanes are (lane, classes). A lane without findings has its calls all the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.findings import _NAMES, SCHEMA, LaneFindings, walked
from siftlake.operators.lanes import class_groups

MODES = ("none", "trace", "gap", "reflect", "sweep")
PASSES, GROUP = 1, 3
YIELDS = "lane string, turn int, mode string, emitted int, added int, revised int"
TOTALS = "lane string, calls long, emitted long, added long, revised long, findings long, steps long"


class Loop:
    """One lane's conversation: findings known, and what each call yielded."""

    def __init__(self, mode: str, passes: int = PASSES, gap_revises: bool = False):
        self.mode, self.passes, self.gap_revises = mode, passes, gap_revises
        self.lane, self.known, self.groups = None, LaneFindings(), []
        self.calls: list[list] = []

    def open(self, lane: str, groups: list[list[str]]) -> None:
        self.lane, self.groups = lane, groups
        self._call()

    def take(self, row: dict) -> None:
        if not self._upto(row["turn"]):
            return
        finding = self._narrowed(row) if self.mode == "sweep" and row["turn"] else row
        if finding is None:
            return
        call, what = self.calls[-1], self._folded(finding)
        call[3] += 1
        call[4] += what == "added"
        call[5] += what == "revised"

    def end(self) -> None:
        """The calls that were made after the last finding."""
        if self.mode == "sweep":
            while len(self.calls) <= len(self.groups):
                self._call()
        elif self.mode != "none" and not self._over():
            self._call()

    def _upto(self, turn: int) -> bool:
        """Make the calls up to a turn; False if it never takes place."""
        most = {"none": 0, "sweep": len(self.groups)}.get(self.mode, self.passes)
        while len(self.calls) <= turn:
            if turn > most or (self.mode != "sweep" and self._over()):
                return False
            self._call()
        return len(self.calls) == turn + 1

    def _over(self) -> bool:
        """Whether no follow-up turn comes after the last call."""
        made = len(self.calls) - 1
        return made >= self.passes or (made > 0 and self.calls[-1][4] + self.calls[-1][5] == 0)

    def _call(self) -> None:
        turn = len(self.calls)
        name = f"sweep:{'+'.join(self.groups[turn - 1])}" if self.mode == "sweep" and turn else self.mode
        self.calls.append([self.lane, turn, name, 0, 0, 0])

    def _narrowed(self, row: dict) -> dict | None:
        group = self.groups[row["turn"] - 1]
        classes = [c for c in row["classes"] if c["class"] in group]
        return {**row, "classes": classes} if classes else None

    def _folded(self, finding: dict) -> str:
        if finding["turn"] == 0:
            self.known.add(finding)
            return "added"
        if self.mode == "gap" and not self.gap_revises and self.known.closest(finding) is not None:
            return "known"
        return self.known.fold(finding)


class _Walk:
    """A loop fed by sorted rows, of which the first says what lane it is. Rows without such a one are of no lane that was asked for."""

    def __init__(self, loop: Loop, out: Callable[[Loop], list[tuple]]):
        self.loop, self.out, self.opened = loop, out, False

    def take(self, row: dict) -> list[tuple]:
        if row["turn"] < 0:
            self.opened = True
            self.loop.open(row["lane"], [list(g) for g in row["groups"]])
        elif self.opened:
            self.loop.take(row)
        return []

    def close(self) -> list[tuple]:
        if not self.opened:
            return []
        self.loop.end()
        return self.out(self.loop)


def _walked(findings: DataFrame, lanes: DataFrame, mode: str, passes: int, group: int, gap_revises: bool, out: Callable[[Loop], list[tuple]], schema: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if passes < 1 or group < 1:
        raise ValueError("passes and group must be positive")
    # Every lane opens with a row before its first turn; lanes without classes have no groups.
    known = class_groups(lanes.select("lane", F.coalesce("classes", F.array().cast("array<string>")).alias("classes")), group)
    opening = known.select("lane", F.lit(-1).alias("turn"), F.lit(-1).cast("long").alias("ord"), F.when(F.size("classes") > 0, F.col("groups")).otherwise(F.array().cast("array<array<string>>")).alias("groups"))
    rows = findings.select(*_NAMES).where("turn >= 0").unionByName(opening, allowMissingColumns=True)
    return walked(rows, ["lane"], ["turn", "ord"], lambda: _Walk(Loop(mode, passes, gap_revises), out), schema)


def replayed(findings: DataFrame, lanes: DataFrame, mode: str, passes: int = PASSES, group: int = GROUP, gap_revises: bool = False) -> DataFrame:
    """The findings that each lane ends with."""
    out = lambda loop: [tuple(f[name] for name in _NAMES) for f in loop.known.known]
    return _walked(findings, lanes, mode, passes, group, gap_revises, out, SCHEMA)


def yields(findings: DataFrame, lanes: DataFrame, mode: str, passes: int = PASSES, group: int = GROUP, gap_revises: bool = False) -> DataFrame:
    """A row for each call: its turn, its mode (in sweep with the group's classes), and findings emitted, added and revised."""
    return _walked(findings, lanes, mode, passes, group, gap_revises, lambda loop: [tuple(c) for c in loop.calls], YIELDS)


def totals(findings: DataFrame, lanes: DataFrame, mode: str, passes: int = PASSES, group: int = GROUP, gap_revises: bool = False) -> DataFrame:
    """A row for each lane, of one walk: its calls, what they yielded in all, and the findings and trace steps that it ends with."""

    def out(loop: Loop) -> list[tuple]:
        emitted, added, revised = (sum(call[i] for call in loop.calls) for i in (3, 4, 5))
        return [(loop.lane, len(loop.calls), emitted, added, revised, len(loop.known.known), sum(len(f["trace"]) for f in loop.known.known))]

    # Of the texts only the title has a say in what is like what.
    bare = findings.withColumns({"finding_id": F.lit(None).cast("string"), "description": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    return _walked(bare, lanes, mode, passes, group, gap_revises, out, TOTALS)
