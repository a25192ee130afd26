"""Nested records, corpora under name-based ids, and batched calls of an embedding service."""

import uuid

import pytest
from pyspark.sql import functions as F

from evidentia.functions import ids
from evidentia.operators import corpus as C
from evidentia.operators import embedding as E
from evidentia.operators import nested as N
from evidentia.streaming import sync

SHAPE = N.Shape("id", "owner", ("name", "place"), ("skills", "jobs"))
PAYLOAD = "id bigint, owner string, name string, place string, skills array<struct<name: string, years: int>>, jobs array<struct<title: string>>"


def test_uuid5(spark):
    names = ["", "a", "profile", "skill:é日本", "x" * 500, None]
    rows = spark.createDataFrame([(n, str(uuid.UUID(int=i))) for i, n in enumerate(names)], "n string, ns string")
    for r in rows.select("n", "ns", ids.uuid5(uuid.NAMESPACE_URL, F.col("n")).alias("one"), ids.uuid5(F.col("ns"), F.col("n")).alias("two")).collect():
        assert r["one"] == (None if r["n"] is None else str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])))
        assert r["two"] == (None if r["n"] is None else str(uuid.uuid5(uuid.UUID(r["ns"]), r["n"])))


def create(spark):
    rows = [
        (1, "ann", "A", None, [("sql", 3), ("spark", None)], [("dev",)]), (2, "ann", "B", "x", [], None), (3, "bob", "C", "y", None, [("lead",), None, ("dev",)]),
    ]
    return N.create(spark.createDataFrame(rows, PAYLOAD), SHAPE)


def shown(tables):
    return {r["id"]: (r["owner"], r["name"], r["place"], [tuple(x) for x in r["skills"]], [x["title"] for x in r["jobs"]]) for r in N.read(tables, SHAPE).collect()}


def test_create_and_read(spark):
    tables = create(spark)
    assert shown(tables) == {
        1: ("ann", "A", None, [("sql", 3), ("spark", None)], ["dev"]), 2: ("ann", "B", "x", [], []), 3: ("bob", "C", "y", [], ["lead", "dev"]),
    }
    children = tables.children["skills"].collect()
    assert {r["record_id"] for r in children} == {str(uuid.uuid5(uuid.NAMESPACE_OID, f"1:skills:{i}")) for i in range(2)}


def test_partial_update(spark):
    """Null leaves fields and sections as they are, an empty section is cleared, payloads of others change nothing."""
    rows = [(1, "ann", None, "home", None, []), (2, "ann", "BB", None, [("go", 1)], None), (3, "ann", "stolen", None, [], []), (9, "ann", "no such", None, None, None)]
    sent = spark.createDataFrame(rows, PAYLOAD)
    tables, counts = N.update(create(spark), sent, SHAPE)
    assert shown(tables) == {
        1: ("ann", "A", "home", [("sql", 3), ("spark", None)], []), 2: ("ann", "BB", "x", [("go", 1)], []), 3: ("bob", "C", "y", [], ["lead", "dev"]),
    }
    assert {r["table"]: (r["updated"], r["deleted"], r["inserted"]) for r in counts.collect()} == {"root": (2, 0, 0), "skills": (0, 0, 1), "jobs": (0, 1, 0)}
    assert sorted(r["id"] for r in N.admitted(create(spark), sent, SHAPE)[1].collect()) == [3, 9]


def test_same_values_are_no_update(spark):
    sent = spark.createDataFrame([(1, "ann", "A", None, None, None)], PAYLOAD)
    _, counts = N.update(create(spark), sent, SHAPE)
    assert {r["table"]: r["updated"] for r in counts.collect()}["root"] == 0


def test_delete(spark):
    doomed = spark.createDataFrame([(1, "ann"), (3, "ann")], "id bigint, owner string")
    assert set(shown(N.delete(create(spark), doomed, SHAPE))) == {2, 3}


def evidence(spark, rows):
    return spark.createDataFrame(rows, "kind string, label string")


def test_corpus(spark):
    rows = [("profile", None), ("skill", "SQL"), ("experience", "Developer - North Studio (2024)"), ("project", "")]
    found = C.corpus(evidence(spark, rows), "kind", "label", uuid.NAMESPACE_DNS, {"experience": {"North": "North Studio", "Studio": "other"}})
    keys = {"profile", "skill:SQL", "experience:North Studio", "project:"}
    assert {(r["key"], r["record_id"]) for r in found.collect()} == {(k, str(uuid.uuid5(uuid.NAMESPACE_DNS, k))) for k in keys}
    cases = spark.createDataFrame([(7, ["skill:SQL", "skill:none"]), (8, [])], "case bigint, relevant array<string>")
    got = [(r["position"], r["key"], r["record_id"] is None) for r in C.resolve(cases, found, "case", "relevant").orderBy("position").collect()]
    assert got == [(0, "skill:SQL", False), (1, "skill:none", True)]
    back = C.keys_of(found.select(F.col("record_id").alias("hit")), found, "hit")
    assert {r["key"] for r in back.collect()} == keys


def test_corpus_errors(spark):
    with pytest.raises(Exception, match="unique: skill:SQL"):
        C.corpus(evidence(spark, [("skill", "SQL"), ("skill", "SQL")]), "kind", "label", uuid.NAMESPACE_DNS).collect()
    with pytest.raises(Exception, match="no key for evidence: Elsewhere"):
        C.corpus(evidence(spark, [("experience", "Elsewhere")]), "kind", "label", uuid.NAMESPACE_DNS, {"experience": {"North": "x"}}).collect()


class Shuffled:
    """Answers from the last text to the first; the first call of each batch fails or answers wrongly."""

    fault = None

    def __init__(self):
        self.seen = set()

    def embed(self, texts):
        key, items = tuple(texts), [E.Item(i, [float(len(t)), 1.0]) for i, t in enumerate(texts)]
        if key not in self.seen:
            self.seen.add(key)
            if self.fault == "raise":
                raise RuntimeError("key sk-secret was refused")
            if self.fault == "drop":
                items = items[:-1]
            if self.fault == "twice":
                items = [E.Item(0, i.embedding) for i in items]
            if self.fault == "nan":
                items[0] = E.Item(0, [float("nan"), 1.0])
            if self.fault == "short":
                items[-1] = E.Item(len(items) - 1, [1.0])
        return E.Response(items[::-1], prompt_tokens=len(texts))


def client(fault, forever=False):
    def connect():
        found = Shuffled()
        found.fault = fault
        if forever:
            found.seen = type("Never", (set,), {"__contains__": lambda *_: False})()
        return found

    return connect


TEXTS = [(i, "x" * (i % 7) if i % 5 else None) for i in range(50)]


@pytest.mark.parametrize("fault", [None, "raise", "drop", "twice", "nan", "short"])
def test_batches(spark, fault):
    """Order is restored, a batch that fails is sent again, and usage counts what was sent."""
    df = spark.createDataFrame(TEXTS, "id int, text string").coalesce(1)
    got = E.Embedder(client(fault), batch_rows=8, batch_chars=20, pause=0)(df).collect()
    assert {r["id"]: r["embedding"] for r in got} == {i: [float(len(t or "")), 1.0] for i, t in TEXTS}
    used = [r["usage"] for r in got if r["usage"]]
    assert sum(u["prompt_tokens"] for u in used) == len(TEXTS)
    assert sum(u["requests"] for u in used) >= len(used) * (2 if fault in ("raise", "drop", "nan") else 1)


@pytest.mark.parametrize("fault,message", [("raise", r"failed 2 times: RuntimeError: key \[redacted\] was refused"), ("drop", "vectors for"), ("twice", "not every text"), ("nan", "not finite"), ("short", "dimensions")])
def test_batches_that_keep_failing(spark, fault, message):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string").coalesce(1)
    with pytest.raises(Exception, match=message) as caught:
        E.Embedder(client(fault, forever=True), dimensions=2, attempts=2, pause=0, secrets=("sk-secret",))(df).collect()
    assert "sk-secret" not in str(caught.value)


def test_cuts():
    embed = E.Embedder(client(None), batch_rows=3, batch_chars=10)
    assert list(embed._cuts(["a" * 25, "", "b", "c", "d" * 9, "e" * 2])) == [(0, 1), (1, 4), (4, 5), (5, 6)]
    assert list(embed._cuts([])) == []


def test_apply_index(spark):
    """The index is filled through the batched client: vectors stand with their texts."""
    kept = spark.createDataFrame([("o", f"e{i}", "x" * i) for i in range(20)], "owner_id string, evidence_id string, text string")
    index = spark.createDataFrame([], "owner_id string, evidence_id string, model string, dimensions int, content_hash string, embedding array<double>")
    plan = sync.plan_index(kept, index, "m")
    after = sync.apply_index(kept, index, plan, "m", E.Embedder(client("raise"), dimensions=2, batch_rows=4, pause=0))
    got = after.join(kept, ["owner_id", "evidence_id"]).collect()
    assert len(got) == 20 and all(r["embedding"] == [float(len(r["text"])), 1.0] and r["dimensions"] == 2 for r in got)
