"""The states of runs, kept by a stream of their events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.operators.runs import CLOSING, ENDED, MESSAGE_CHARS, MOVES

STATE = "status string, stage string, moves bigint, refused bigint, first_refused bigint, failed_stage string, error_type string, message string, opened timestamp, latency_ms bigint, finished_at timestamp"
NAMES = tuple(part.split()[0] for part in STATE.split(", "))
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(state: dict, event: dict) -> dict:
    """A run after one event; one that is no legal move is counted and changes nothing else."""
    target = MOVES.get((state["status"], event["event"]))
    if target is None:
        first = state["first_refused"] if state["first_refused"] is not None else event["id"]
        return state | {"refused": state["refused"] + 1, "first_refused": first}
    new = state | {"status": target, "moves": state["moves"] + 1}
    if event["event"] == "start":
        new |= {"stage": event["stage"], "opened": event["at"]}
    if event["event"] in CLOSING:
        if state["opened"] is not None:
            new["latency_ms"] += max(0, (event["at"] - state["opened"]) // pd.Timedelta(milliseconds=1))
        new["opened"] = None
    if event["event"] == "fail":
        new |= {"failed_stage": state["stage"], "error_type": event["error_type"], "message": event["message"] and event["message"][:MESSAGE_CHARS]}
    if target in ENDED:
        new["finished_at"] = event["at"]
    return new


class Lifecycle(StatefulProcessor):
    """One state for each run; each micro-batch passes on the new state of the runs that it touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else ("none", None, 0, 0, None, None, None, None, None, 0, None)
        state = {n: None if pd.isna(v) else v for n, v in zip(NAMES, held, strict=True)}
        if state["opened"] is not None:
            state["opened"] = pd.Timestamp(state["opened"])
        events = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        for event in events.astype(object).where(events.notna(), None).to_dict("records"):
            state = advance(state, event)
        self.state.update(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in state.values()))
        yield pd.DataFrame({"run": [key[0]]} | {n: [v] for n, v in state.items()})

    def close(self) -> None:
        pass


def stream_lifecycle(events: DataFrame, run: str, kind: str = "bigint") -> DataFrame:
    """A stream of (run, its state) rows, one for each run and micro-batch that has events of it, from a stream of (run, id, at, event, stage, error_type, message).

    Events count in the order of (at, id) within a micro-batch, and micro-batches in theirs: an event that comes late is judged by the
    state that it meets.  The session's state store must be ``PROVIDER``."""
    rows = events.select(events[run].alias("run"), "id", "at", "event", "stage", "error_type", "message")
    return rows.groupBy("run").transformWithStateInPandas(Lifecycle(), f"run {kind}, {STATE}", "Update", "None")
