"""Budget tracking of a run, in batch and as a stateful stream.

Reports (run, ord, lane_id, tokens_used, seconds_elapsed, nearly_done, estimated_remaining) are
cumulative per lane. A lane stops at its token ceiling, else at its seconds; a run stops at a cap
on the sum of its lanes' latest tokens. The cap couples the lanes, so the state is kept per run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftlake.operators.findings import walked

OUT = "run string, ord long, lane_id string, ok boolean, stop string, framing string, run_tokens long"
NONE, TOKENS, SECONDS, GLOBAL = "none", "lane_token_ceiling", "lane_wall_clock_ceiling", "global_cap"


class Tracker:
    """State of one run. plan: lane -> (token ceiling, seconds ceiling)."""

    def __init__(self, plan: dict[str, tuple[int, int]], cap: int | None, state: dict | None = None):
        self.plan, self.cap = plan, cap
        self.state = state or {"tokens": {}, "stopped": {}, "over": False, "total": 0}

    @staticmethod
    def framing(report: dict, ceiling: float) -> str:
        left = report["estimated_remaining"]
        near = bool(report["nearly_done"]) and left is not None and not pd.isna(left) and ceiling > 0 and left <= 0.25 * ceiling
        return "bounded_ask" if near else "architectural_concern"

    def report(self, report: dict) -> tuple[bool, str, str | None, int]:
        state, lane = self.state, report["lane_id"]
        stop = None
        if state["over"]:
            stop = (GLOBAL, "architectural_concern")
        elif lane in state["stopped"]:
            stop = (TOKENS, "architectural_concern")
        else:
            latest = int(report["tokens_used"])
            state["total"] += latest - state["tokens"].get(lane, 0)
            state["tokens"][lane] = latest
            if lane in self.plan:
                most, seconds = self.plan[lane]
                if report["tokens_used"] >= most:
                    stop = (TOKENS, self.framing(report, most))
                elif report["seconds_elapsed"] >= seconds:
                    stop = (SECONDS, self.framing(report, seconds))
                if stop:
                    state["stopped"][lane] = True
                elif self.cap is not None and state["total"] >= self.cap:
                    state["over"] = True
                    stop = (GLOBAL, self.framing(report, 0))
        return (stop is None, *(stop or (NONE, None)), state["total"])

    def take(self, report: dict) -> list[tuple]:
        return [(report["run"], report["ord"], report["lane_id"], *self.report(report))]

    def close(self) -> list[tuple]:
        return []


def _rows(tracker: Tracker, run: str, frame: pd.DataFrame) -> pd.DataFrame:
    out = [(run, r["ord"], r["lane_id"], *tracker.report(r)) for r in frame.sort_values("ord").to_dict("records")]
    return pd.DataFrame(out, columns=["run", "ord", "lane_id", "ok", "stop", "framing", "run_tokens"])


def track(reports: DataFrame, plan: dict[str, tuple[int, int]], cap: int | None = None) -> DataFrame:
    """The tracker's answer to every report of finished runs. A run's reports are walked in order; a task holds the state of one run."""
    return walked(reports, ["run"], ["ord"], lambda: Tracker(plan, cap), OUT)


class TrackRun(StatefulProcessor):
    def __init__(self, plan: dict[str, tuple[int, int]], cap: int | None):
        self.plan, self.cap = plan, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("tracker", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        tracker = Tracker(self.plan, self.cap, state)
        yield _rows(tracker, key[0], pd.concat(list(rows)))
        self.kept.update((json.dumps(tracker.state),))

    def close(self) -> None:
        pass


def track_stream(reports: DataFrame, plan: dict[str, tuple[int, int]], cap: int | None = None) -> DataFrame:
    """The same over a stream; each micro-batch is taken in order of `ord`, and state survives restarts in the checkpoint.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    return reports.groupBy("run").transformWithStateInPandas(TrackRun(plan, cap), OUT, "Append", "None")
