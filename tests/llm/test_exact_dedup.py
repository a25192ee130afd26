import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from evidentia.llm import cuckoo


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_against_a_dict():
    rng, index, live = random.Random(3), cuckoo.CuckooIndex(4), {}
    for _ in range(6000):
        k = key(rng.randrange(1500))
        if rng.random() < 0.7:
            doc = rng.randrange(10**6)
            index.insert(k, doc, 2)
            old = live.get(k, (None, 0))
            live[k] = (doc if old[0] is None else max(doc, old[0]), old[1] + 2)
        else:
            assert index.delete(k) == (k in live)
            live.pop(k, None)
    assert index.live == len(live) and index.buckets > 4  # it has overflowed
    assert {x[0]: (x[1], x[2]) for x in index.entries()} == live
    assert all(index.find(key(i)) >= 0 for i in range(1500) if key(i) in live)
    assert all(index.find(key(i)) < 0 for i in range(1500) if key(i) not in live)


def test_same_fingerprint_is_no_hit():
    index = cuckoo.CuckooIndex()
    a = b"a" * 22 + key(1)[22:]
    b = b"b" * 22 + key(1)[22:]
    index.insert(a, 1, 1)
    assert index.find(a) >= 0 and index.find(b) < 0
    index.insert(b, 2, 1)
    assert index.live == 2 and index.delete(a) and index.find(b) >= 0


def test_row_round_trip():
    index = cuckoo.CuckooIndex(8)
    for i in range(40):
        index.insert(key(i), None if i % 5 == 0 else i, 1)
    from pyspark.sql import Row

    back = cuckoo.CuckooIndex.from_row(Row(**index.to_row(3)))
    assert sorted(map(repr, back.entries())) == sorted(map(repr, index.entries())) and back.live == 40
    assert all(back.find(key(i)) == index.find(key(i)) for i in range(60))


def brute_force(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_dedup(make):
    rows = [(i, f"Text {i % 7}") for i in range(40)] + [(100, None), (101, ""), (102, "ÄB"), (103, "äb"), (104, "Äb"), (5, "Text 5"), (None, "Text 1"), (None, "alone"), (200, "x" * 200_000)]
    df = cuckoo.deduplicate(make(rows).withColumns({"keep_id": F.lit(1), "digest": F.lit("x"), "_salt": F.lit(0)}))
    found = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in df.collect()), key=repr)
    assert found == brute_force(rows)


def test_dedup_of_nothing(make):
    assert cuckoo.deduplicate(make([])).collect() == []


def test_index_over_batches(spark, make):
    def entries(rows):
        df = make(rows).select(F.col("doc_id").alias("_id"), cuckoo.digest("text").alias("digest"), F.lit(0).alias("_salt"))
        return cuckoo.entries_of(df)

    index = cuckoo.insert(cuckoo.empty_index(spark), entries([(1, "a"), (2, "b"), (3, "A")]), 4)
    index = cuckoo.insert(index, entries([(9, "b"), (4, "c")]), 4)
    index = cuckoo.delete(index, make([(0, "a"), (0, "zz")]).select(cuckoo.digest("text").alias("digest")), 4).cache()
    asked = cuckoo.probe(index, entries([(7, "a"), (7, "b"), (7, "c"), (7, "d")]), 4)
    names = {hashlib.sha256(t.encode()).digest(): t for t in "abcd"}
    assert {names[bytes(r["digest"])]: (r["keep_id"], r["group_size"]) for r in asked.collect()} == {"a": (None, 0), "b": (9, 2), "c": (4, 1), "d": (None, 0)}
