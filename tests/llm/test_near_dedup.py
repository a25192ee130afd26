import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.llm import neardup, store
from evidentia.llm.components import components


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))


def brute_force(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def found(df):
    return sorted((tuple(r) for r in neardup.near_duplicates(df).collect()), key=repr)


def edited(text, rng, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates(make, prose):
    rng, rows = random.Random(5), []
    for g in range(12):
        base = prose(g, 60 + 20 * g)
        rows += [(100 * g + 7 * k, edited(base, rng, k % 5)) for k in range(9)]
    passage = prose(99, 40)
    rows += [(5000 + k, f"{prose(300 + k, 12)} {passage} {prose(600 + k, 15)}") for k in range(25)]  # share a passage, no near copies
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c d"), (7, rows[0][1].upper()), (None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1])]
    df = make(rows).withColumns({"n": F.lit(0), "rep": F.lit(0), "_id": F.lit(0), "component_id": F.lit("x")})
    assert found(df) == brute_force(rows)


def test_chain_of_copies_and_long_text(make, prose):
    words = prose(1, 20_000).split()
    rows = [(1, " ".join(words)), (2, " ".join(words[: 19_000]))]
    chain = prose(2, 100).split()
    for k in range(12):  # each is near the next, the ends are far apart
        rows.append((10 + k, " ".join(chain[k * 5 :] + [f"x{i}" for i in range(k * 5)])))
    assert found(make(rows)) == brute_force(rows)


def test_near_duplicates_of_nothing(make):
    assert found(make([])) == [] and found(make([(3, None)])) == [(3, 0, 3, True)]


def test_blocks_equal_one_block(make, prose, monkeypatch):
    rng, base = random.Random(1), prose(5, 80)
    rows = [(k, edited(base, rng, 8)) for k in range(30)]
    whole = found(make(rows))
    monkeypatch.setattr(neardup, "BLOCK", 4)
    assert found(make(rows)) == whole == brute_force(rows)


def test_every_pair_across_components_meets_and_large_ones_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 50)
    rows = [(7, r, 0 if r < 3000 else r // 2, 5) for r in range(3020)] + [(8, r, r, 5) for r in range(130)] + [(9, r, 1, 5) for r in range(9)]
    scratch = neardup.store.Scratch(spark)
    dealt = neardup.dealt(spark.createDataFrame(rows, "key bigint, rep bigint, comp bigint, n int"), scratch, "t").collect()
    assert sum(r["key"] == 7 for r in dealt) < 3000 + 20 * 70 and not any(r["key"] == 9 for r in dealt)
    groups = {}
    for r in dealt:
        groups.setdefault((r["key"], r["i"], r["j"]), []).append(r)
    assert max(map(len, groups.values())) < 250
    met = set()
    for (key, i, _), own in groups.items():
        for a in own:
            for b in own:
                if a["comp"] != b["comp"] and (i < 0 or a["main"] != b["main"]):
                    met.add((key, a["rep"], b["rep"]))
    want = {(k, a, b) for k, a, c, _ in rows for m, b, d, _ in rows if k == m and c != d and k != 7} | {(7, a, b) for a in range(3020) for b in range(3000, 3020) if a // 2 != b // 2}
    assert want <= met


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(i, i + 1) for i in range(2000, 2064)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_few_but_long_words(prose):
    texts = [prose(i, 40).encode() for i in range(5)]
    wide, tight = neardup.Shingler(), neardup.Shingler(table_bytes=1)
    assert all((wide.set_of(t) == tight.set_of(t)).all() for t in texts * 2)
    assert tight.held < wide.held


def test_band_that_collides_in_sketch_bytes_only():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**63, neardup.BANDS * neardup.ROWS, np.uint64)
    two = one.copy()
    byte = lambda x: neardup.mixed(x) >> np.uint64(56)
    others = rng.integers(0, 2**63, 10_000, np.uint64)
    two[0] = others[byte(others) == byte(one[:1])][0]  # band 0 differs, though its bytes are equal
    assert two[0] != one[0] and (byte(one) == byte(two)).all()
    keys = np.stack([neardup.band_keys(one), neardup.band_keys(two)])
    assert (keys[0] == keys[1]).tolist() == [False] + [True] * (neardup.BANDS - 1)

    def candidates(band):
        sketch = byte(one).astype(np.uint8).tobytes()
        rows = [{"key": int(k[band]), "band": band, "rep": r, "comp": r, "n": 9, "sketch": sketch, "earlier": k[:band].tolist(), "block": 0, "main": False, "i": -1, "j": 0} for r, k in enumerate(keys)]
        return sum(len(a) for a, _ in neardup._candidates(pa.Table.from_pylist(rows)))

    assert [candidates(b) for b in range(1, 5)] == [1, 0, 0, 0]  # in the first bucket that both are in, and nowhere else


def test_many_components_in_one_bucket(spark):
    """16,000 members of as many components are dealt fewer than ten times each."""
    members = spark.range(16_000).selectExpr("1L AS key", "id AS rep", "id AS comp", "100 AS n")
    assert neardup.dealt(members, store.Scratch(spark), "many").count() < 10 * 16_000
