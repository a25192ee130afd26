"""The states of runs in batches and as a stream, and the view of a run with everything around it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import runs as R
from evidentia.streaming import lifecycle as S

SCHEMA = "run bigint, id bigint, at timestamp, event string, stage string, error_type string, message string"
START = dt.datetime(2024, 5, 1)


def made(seed, n_runs, n):
    rng = random.Random(seed)
    names = ["start", "complete", "start", "complete", "wait", "approve", "reject", "fail", "finish", "start", "unknown", None]
    rows = []
    for i in range(n):
        at = START + dt.timedelta(seconds=rng.choice([i * 1000, i * 1000, 5000]), microseconds=rng.randrange(10**6))
        rows.append((rng.randrange(n_runs), i, at, rng.choice(names), f"stage {i}", "Timeout", rng.choice([None, "m" * 500, "short"])))
    return rows


def folded(rows):
    """{run: the state after its events in order}, event by event."""
    out = {}
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        run, id_, at, event, stage, error, message = row
        s = out.setdefault(run, {"status": "none", "stage": None, "moves": 0, "refused": 0, "first": None, "failure": None, "opened": None, "ms": 0, "ended": None})
        target = R.MOVES.get((s["status"], event))
        if target is None:
            s["refused"] += 1
            s["first"] = id_ if s["first"] is None else s["first"]
            continue
        s["status"], s["moves"] = target, s["moves"] + 1
        if event == "start":
            s["stage"], s["opened"] = stage, at
        if event in R.CLOSING:
            if s["opened"] is not None:
                s["ms"] += (at - s["opened"]) // dt.timedelta(milliseconds=1)
            s["opened"] = None
        if event == "fail":
            s["failure"] = (s["stage"], error, message and message[:400])
        if target in R.ENDED:
            s["ended"] = at
    return {k: tuple(v[n] for n in ("status", "stage", "moves", "refused", "first", "failure", "ms", "ended")) for k, v in out.items()}


@pytest.mark.parametrize("chunk", ["second", "hour", "year"])
def test_lifecycle(spark, chunk):
    """Whatever the chunks, as by taking one event after the other."""
    rows = made(1, 6, 400)
    got = R.lifecycle(spark.createDataFrame(rows, SCHEMA), "run", chunk).collect()
    assert {r["run"]: (r["status"], r["current_stage"], r["moves"], r["refused"], r["first_refused"], r["failure"] and tuple(r["failure"]), r["latency_ms"], r["finished_at"]) for r in got} == folded(rows)
    assert {v[0] for v in folded(rows).values()} & set(R.ENDED)


@pytest.mark.parametrize("long", [0, 70, 10_000])
@pytest.mark.parametrize("chunk", ["second", "hour", "year"])
def test_short_and_long_runs(spark, chunk, long):
    """Whether folded at once or in chunks; times and runs may be null, long runs stand beside short ones."""
    rows = [(r[0] if r[0] < 5 or r[1] % 9 == 0 else 0, *r[1:]) for r in made(3, 6, 400)]
    got = R.lifecycle(spark.createDataFrame([*rows, (None, 1, START, "start", "x", None, None), (None, 0, None, "fail", None, None, None)], SCHEMA), "run", chunk, long)
    got = {r["run"]: (r["status"], r["current_stage"], r["moves"], r["refused"], r["first_refused"], r["failure"] and tuple(r["failure"]), r["latency_ms"], r["finished_at"]) for r in got.collect()}
    assert got.pop(None) == ("running", "x", 1, 1, 0, None, 0, None) and got == folded(rows)


def test_long_runs_reach_every_state(spark):
    rows = [r for seed in range(30) for r in [(seed, *x[1:]) for x in made(seed, 1, 12)]]
    want = folded(rows)
    got = {r["run"]: r["status"] for r in R.lifecycle(spark.createDataFrame(rows, SCHEMA), "run", "minute").collect()}
    assert got == {k: v[0] for k, v in want.items()} and set(got.values()) >= {"running", "failed"}


def test_stages_across_chunks(spark):
    rows = [(1, 0, START, "start", "a", None, None), (1, 1, START + dt.timedelta(hours=5, microseconds=1999), "fail", None, "E", "x"), (1, 2, START + dt.timedelta(hours=6), "start", "b", None, None)]
    got = R.lifecycle(spark.createDataFrame(rows, SCHEMA), "run").first()
    assert (got["status"], got["latency_ms"], tuple(got["failure"]), got["refused"], got["first_refused"]) == ("failed", 5 * 3600 * 1000 + 1, ("a", "E", "x"), 1, 2)


def test_no_events(spark):
    assert R.lifecycle(spark.createDataFrame([], SCHEMA), "run").count() == 0


def test_latency(spark):
    pairs = [(START, START + dt.timedelta(microseconds=1999), 1), (START, START - dt.timedelta(seconds=1), 0), (START, START, 0)]
    got = spark.createDataFrame(pairs, "a timestamp, b timestamp, w bigint").select(R.latency_ms(F.col("a"), F.col("b")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)


def test_stream_gives_the_same_states(spark, tmp_path):
    """Events in files, one a micro-batch: the last state of each run is that of the batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    rows = sorted(made(2, 4, 60), key=lambda r: (r[2], r[1]))
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    found = []

    def collect(df, batch):
        found.extend((batch, *r) for r in df.select("run", *S.NAMES).collect())

    # files are taken in the order in which they were written
    query = S.stream_lifecycle(events, "run").writeStream.outputMode("update").foreachBatch(collect).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None and len({f[0] for f in found}) == 3
    last = {}
    for _, run, *state in sorted(found, key=lambda f: f[0]):
        last[run] = dict(zip(S.NAMES, state, strict=True))
    got = {
        run: (s["status"], s["stage"], s["moves"], s["refused"], s["first_refused"], (s["failed_stage"], s["error_type"], s["message"]) if s["failed_stage"] else None, s["latency_ms"], s["finished_at"])
        for run, s in last.items()
    }
    assert got == folded(rows)


def test_read_model(spark):
    runs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", "z")], "run bigint, owner string, note string")
    drafts = spark.createDataFrame([(1, 5, "old"), (1, 7, "new"), (3, 1, "only"), (9, 1, "no run"), (None, 1, "no key")], "run_id bigint, version int, title string")
    documents = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (3, 1, None)], "run_id bigint, position int, path string")
    children = {"draft": R.Child(drafts, "run_id", ("version",), ("title", "version")), "documents": R.Child(documents, "run_id", ("position",), ("path",), many=True)}
    found = R.read_model(runs, "run", children)
    got = {r["run"]: (r["owner"], r["note"], r["draft"] and r["draft"]["title"], [x["path"] for x in r["documents"]]) for r in found.collect()}
    assert got == {1: ("a", "x", "new", ["a", "b"]), 2: ("a", None, None, []), 3: ("b", "z", "only", [None])}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    own = R.read_model(runs, "run", children, ("owner", "a"))
    assert {r["run"] for r in own.collect()} == {1, 2}


def test_reviewable(spark):
    rows = [("running", 1, True, "not awaiting review"), (None, 1, True, "not awaiting review"), ("awaiting_review", None, True, "no draft"), ("awaiting_review", 1, None, "not grounded"), ("awaiting_review", 1, True, None)]
    got = spark.createDataFrame(rows, "s string, d int, g boolean, w string").select(R.reviewable(F.col("s"), F.col("d"), F.col("g")).alias("r"), "w").collect()
    assert all(r["r"] == r["w"] for r in got)
