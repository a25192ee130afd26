"""Runs: the states that their events lead through, and the view that joins a run with the latest of everything around it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a run, and the moves between them; a run that is rejected, failed or completed stays so.
STATES = ("none", "running", "awaiting_review", "completed", "rejected", "failed")
MOVES = {
    ("none", "start"): "running",
    ("running", "start"): "running",
    ("running", "complete"): "running",
    ("running", "wait"): "awaiting_review",
    ("running", "finish"): "completed",
    ("running", "fail"): "failed",
    ("awaiting_review", "approve"): "running",
    ("awaiting_review", "reject"): "rejected",
}
EVENTS = tuple(dict.fromkeys(e for _, e in MOVES))
CLOSING = ("complete", "wait", "fail")
ENDED = ("completed", "rejected", "failed")
MESSAGE_CHARS = 400
#: Events of a run that are folded at once; those of longer runs are folded in chunks.
LONG = 10_000


def latency_ms(started: Column, finished: Column) -> Column:
    """Whole milliseconds between two timestamps, never less than 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1000)).cast("bigint")


RESULT = (
    "state: int, moves: bigint, refused: bigint, refused_id: bigint, stage: string, failure: struct<stage: string, error_type: string, message: string>, "
    "opened: timestamp, carried: boolean, early: timestamp, latency_ms: bigint, ended_at: timestamp"
)


def _code(event: Column) -> Column:
    """Place of an event in ``EVENTS``, from 1; 0 for any other and for null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, EVENTS)), event).cast("int"), F.lit(0))


def _step(s: Column, e: Column) -> Column:
    """What an event makes of a run; one that is no legal move is counted and changes nothing else."""
    table = [STATES.index(MOVES[state, event]) if (state, event) in MOVES else -1 for state in STATES for event in EVENTS]
    target = F.when(e["code"] > 0, F.element_at(F.array(*map(F.lit, table)), s["state"] * len(EVENTS) + e["code"])).otherwise(-1)
    names = [part.split(":")[0] for part in RESULT.split(", ") if not part.startswith(("error_type", "message"))]

    def changed(**to: Column) -> Column:
        return F.struct(*(to.get(n, s[n]).alias(n) for n in names))

    def moved(target: Column) -> Column:
        starts, closes = e["code"] == EVENTS.index("start") + 1, e["code"].isin(*(EVENTS.index(x) + 1 for x in CLOSING))
        fails, ends = e["code"] == EVENTS.index("fail") + 1, target.isin(*(STATES.index(x) for x in ENDED))
        failure = F.struct(s["stage"].alias("stage"), e["error_type"].alias("error_type"), e["message"].alias("message"))
        return changed(
            state=target, moves=s["moves"] + 1, stage=F.when(starts, e["stage"]).otherwise(s["stage"]), failure=F.when(fails, failure).otherwise(s["failure"]),
            opened=F.when(starts, e["at"]).when(closes, F.lit(None)).otherwise(s["opened"]), carried=s["carried"] & ~starts & ~closes, early=F.coalesce(s["early"], F.when(closes & s["carried"], e["at"])),
            latency_ms=s["latency_ms"] + F.when(closes & s["opened"].isNotNull(), latency_ms(s["opened"], e["at"])).otherwise(0), ended_at=F.when(ends, e["at"]).otherwise(s["ended_at"]),
        )

    refused = changed(refused=s["refused"] + 1, refused_id=F.coalesce(s["refused_id"], e["id"]))
    return F.element_at(F.transform(F.array(target), lambda t: F.when(t >= 0, moved(t)).otherwise(refused)), 1)  # the target is looked up once


def _begin(state: Column, carried: bool) -> Column:
    zero = F.lit(0).cast("bigint")
    none = F.lit(None)
    values = (state.cast("int"), zero, zero, none, none, none, none, F.lit(carried), none, zero, none)
    names = ("state", "moves", "refused", "refused_id", "stage", "failure", "opened", "carried", "early", "latency_ms", "ended_at")
    return F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True))).cast(f"struct<{RESULT}>")


def _followed(s: Column, fns: Column) -> Column:
    """A run after a chunk of events, of which ``fns`` tells what it does from each state."""
    f = F.element_at(fns, s["state"] + 1)
    held = F.struct(F.coalesce(f["failure"]["stage"], s["stage"]).alias("stage"), f["failure"]["error_type"].alias("error_type"), f["failure"]["message"].alias("message"))
    closed = F.when(f["early"].isNotNull() & s["opened"].isNotNull(), latency_ms(s["opened"], f["early"])).otherwise(0)
    return F.struct(
        f["state"].alias("state"), (s["moves"] + f["moves"]).alias("moves"), (s["refused"] + f["refused"]).alias("refused"), F.coalesce(s["refused_id"], f["refused_id"]).alias("refused_id"),
        F.coalesce(f["stage"], s["stage"]).alias("stage"), F.when(f["failure"].isNotNull(), held).otherwise(s["failure"]).alias("failure"), F.when(f["carried"], s["opened"]).otherwise(f["opened"]).alias("opened"),
        (s["carried"] & f["carried"]).alias("carried"), F.coalesce(s["early"], f["early"]).alias("early"), (s["latency_ms"] + f["latency_ms"] + closed).alias("latency_ms"),
        F.coalesce(f["ended_at"], s["ended_at"]).alias("ended_at"),
    ).cast(f"struct<{RESULT}>")


def lifecycle(events: DataFrame, run: str, chunk: str = "hour", long: int = LONG) -> DataFrame:
    """(run, status, current_stage, moves, refused, first_refused, failure, latency_ms, finished_at) of each run after all its events.

    ``events`` has (run, id, at, event, stage, error_type, message), ids bigint, taken in the order of (at, id).  Illegal moves are refused:
    they are counted, the first is named, and the run stays as it was.  ``latency_ms`` adds up the stages that were closed.  The events of a
    run of at most ``long`` events are folded at once.  Those of a longer one are folded in chunks of time, each from every state, and the
    chunks, which compose, in order: a run with a third of all events is worked on by as many tasks as it has chunks.  Runs are counted
    first; the long ones, at most one in ``long`` events, are broadcast.  Runs without a legal event have the status "none"."""
    counted = events.groupBy(run).agg(F.count("*").alias("_n")).filter(F.col("_n") > long).select(F.col(run).alias("_run"), F.lit(True).alias("_long"))
    code = _code(F.col("event"))
    # only a start tells its stage, only a failure its error
    starts, fails = code == EVENTS.index("start") + 1, code == EVENTS.index("fail") + 1
    what = (F.when(starts, F.col("stage")).alias("stage"), F.when(fails, F.col("error_type")).alias("error_type"), F.when(fails, F.substring("message", 1, MESSAGE_CHARS)).alias("message"))
    e = events.select(run, "at", F.struct("at", "id", code.alias("code"), *what).alias("_e")).join(F.broadcast(counted), F.col(run).eqNullSafe(F.col("_run")), "left")
    keys = [run, "_long", "_chunk"]
    e = e.select(run, "_long", F.when(F.col("_long"), F.date_trunc(chunk, F.col("at"))).alias("_chunk"), "_e").repartition(*keys)
    states = [_begin(F.lit(i), True) for i in range(len(STATES))]
    begun = F.when(F.col("_long"), F.array(*states)).otherwise(F.array(states[0]))
    folded = F.aggregate(F.sort_array(F.collect_list("_e")), begun, lambda acc, x: F.transform(acc, lambda s: _step(s, x)))
    parts = e.groupBy(*keys).agg(folded.alias("_f"))
    whole = F.aggregate(F.sort_array(F.collect_list(F.struct("_chunk", "_f"))), _begin(F.lit(0), False), lambda s, x: _followed(s, x["_f"]))
    done = parts.groupBy(run).agg(whole.alias("_s"))
    return done.select(
        run, F.element_at(F.array(*map(F.lit, STATES)), F.col("_s.state") + 1).alias("status"), F.col("_s.stage").alias("current_stage"), "_s.moves", "_s.refused",
        F.col("_s.refused_id").alias("first_refused"), "_s.failure", "_s.latency_ms", F.col("_s.ended_at").alias("finished_at"),
    )


@dataclass(frozen=True)
class Child:
    """A table around a run: ``key`` names the run, ``order`` what is latest, ``fields`` what is shown; ``many`` shows all rows, else the latest."""

    rows: DataFrame
    key: str
    order: tuple[str, ...]
    fields: tuple[str, ...]
    many: bool = False


def read_model(runs: DataFrame, key: str, children: dict[str, Child], owner: tuple[str, object] | None = None) -> DataFrame:
    """Each run with the latest row of each child (null where there is none) or all of them in order (empty where there is none).

    Runs and children are one union, so all of them meet in one shuffle on the run's key, latest rows already taken on the side of the
    scan.  With ``owner`` (column, value) only that owner's runs are shown, and those of others are not found.  The lists of a run
    are as long as what it has; children without a run are left out."""
    shown = runs if owner is None else runs.filter(F.col(owner[0]) == owner[1])
    rest = [c for c in shown.columns if c != key]
    picked = {n: c.rows.select(F.col(c.key).alias(key), F.struct(F.struct(*c.order).alias("order"), F.struct(*c.fields).alias("row")).alias("child")) for n, c in children.items()}
    kinds = {n: p.schema["child"].dataType.simpleString() for n, p in picked.items()}
    own = shown.select(key, F.struct(*rest).alias("_run"), *(F.lit(None).cast(k).alias(n) for n, k in kinds.items()))
    kind = own.schema["_run"].dataType.simpleString()
    parts = [p.select(key, F.lit(None).cast(kind).alias("_run"), *((F.col("child") if m == n else F.lit(None).cast(k)).alias(m) for m, k in kinds.items())) for n, p in picked.items()]
    both = reduce(DataFrame.union, [own, *parts])
    found = both.groupBy(key).agg(F.first("_run", ignorenulls=True).alias("_run"), *((F.array_sort(F.collect_list(n)) if c.many else F.max(n)).alias(n) for n, c in children.items()))
    return found.filter("_run is not null").select(key, "_run.*", *((F.transform(n, lambda x: x["row"]) if c.many else F.col(f"{n}.row")).alias(n) for n, c in children.items()))


def reviewable(status: Column, draft: Column, grounding_valid: Column) -> Column:
    """Why a run cannot be reviewed: it does not wait for that, it has no draft, or its draft is not grounded; null where it can."""
    return (
        F.when(F.coalesce(status != "awaiting_review", F.lit(True)), "not awaiting review").when(draft.isNull(), "no draft").when(~F.coalesce(grounding_valid, F.lit(False)), "not grounded")
    )
