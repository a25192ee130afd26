import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import conversations as C

WHITE = " \t\n\v\f\r"
SOUND = re.compile(r"(s?(ua)+)?")


def parsed(symbols, grammar=None):
    """(cost, audit) of a parse in one piece."""
    grammar = grammar or C.role_grammar()
    column = C.parse(grammar, symbols, grammar.start)
    return min(v for n, v in column.items() if n in grammar.accepted)[:2]


def cheapest(symbols, costs=C.Costs(), insertions=2):
    """All sequences of edits with at most some insertions at each place, by trial."""
    options = []
    for x in symbols:
        found = [(costs.delete, "D", "")]
        if x != C.FAULTY:
            more = costs.truncated if x.isupper() else 0
            found += [(more, "K", x.lower()), (more + costs.rerole, "R", "u"), (more + costs.rerole, "R", "a")]
        options.append(found)
    inserted = [[(costs.insert * k, "I" * k, "".join(x)) for k in range(insertions + 1) for x in itertools.product("ua", repeat=k)]]
    steps = inserted + [part for o in options for part in (o, *inserted)]
    best = None
    for way in itertools.product(*steps):
        if SOUND.fullmatch("".join(w[2] for w in way)):
            found = sum(w[0] for w in way), "".join(w[1] for w in way)
            best = found if best is None or found < best else best
    return best


@pytest.mark.parametrize("symbols", ["", "u", "s", "ua", "sua", "au", "uua", "uaa", "suau", "oa", "UA", "xuax", "ss", "aU", "uox"])
def test_least_repair(symbols):
    assert parsed(symbols) == cheapest(symbols, insertions=1)


@settings(max_examples=25, deadline=None)
@given(st.text("suaoSUAOx", max_size=3), st.sampled_from([C.Costs(), C.Costs(3, 9, 1, 2), C.Costs(1, 1, 1, 1), C.Costs(2, 4, 2, 1)]))
def test_least_repair_at_other_costs(symbols, costs):
    """Where insertions are cheap too, and ties are between audits of different lengths."""
    assert parsed(symbols, C.role_grammar(costs)) == cheapest(symbols, costs)


@settings(max_examples=100, deadline=None)
@given(st.text("suaoSUAOx", max_size=14), st.integers(1, 5), st.sampled_from([C.Costs(), C.Costs(2, 4, 2, 1)]))
def test_segments_give_the_same(symbols, size, costs):
    grammar = C.role_grammar(costs)
    own = []
    for number, at in enumerate(range(0, len(symbols), size)):
        part = symbols[at : at + size]
        paths = [dict(zip(("seed", "name", "cost", "audit", "roles"), (seed, n, *v), strict=True)) for seed in grammar.nonterminals for n, v in C.parse(grammar, part, seed).items()]
        own.append({"part": 0, "number": number, "paths": paths})
    if own:
        cost, chosen = C.join_segments(grammar, own[::-1])
        assert (cost, "".join(c["audit"] for c in chosen)) == parsed(symbols, grammar)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows)} with a plain table of states."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            visible = text.strip(WHITE)
            fault = 0 if not visible else 1 if (role, text) in seen else 2 if visible[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            symbols.append((role[:1], fault))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        # from the last row: state -> (cost, audit, repaired), by what the rest begins with
        best = {"": (0, "", [])}
        for (_, _, role, text), (initial, fault) in zip(own[::-1], symbols[::-1]):
            new = {}
            for state, (cost, audit, rest) in best.items():
                ways = [(state, cost + 2, "D" + audit, rest)]
                if fault not in (0, 1):
                    more = 5 if fault == 2 else 0
                    for letter, x, r, c in (("K", initial, role, 0), ("R", "u", "user", 1), ("R", "a", "assistant", 1)):
                        if x and x + state in ("a", "ua", "au", "su"):
                            ways.append((x, cost + more + c, letter + audit, [f"{r}:{text}", *rest]))
                for name, *value in ways:
                    if name not in new or value[:2] < list(new[name][:2]):
                        new[name] = tuple(value)
            best = new
        cost, audit, rest = min((v for n, v in best.items() if n != "a"), key=lambda v: v[:2])
        out[conv] = (gaps, *counts, illegal, cost, audit, "\n".join(rest))
    return out


def by_operator(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = C.repair(df, **options)
    hashes = {r["conv"]: r["sha256"] for r in C.digests(found.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv"]: (*(r[n] for n in names), hashes.get(r["conv"], empty)) for r in found.report.collect()}


def hashed(found):
    return {k: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for k, v in found.items()}


def rows_of(rng, n):
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", "Agent", "agent"], ["Yes.", "No", "Why?", " ", "", "Go on!\n", "é …", "x. y"]
    return [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_rows(spark, segment):
    import random

    rows = rows_of(random.Random(5), 90)
    rows += [(7, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(40)] + [(8, 0, "user", "Same.")] * 9 + [(9, None, "assistant", "word " * 30_000 + "."), (9, None, "user", "Hello.")]
    assert by_operator(spark, rows, segment=segment) == hashed(brute(rows))


def test_damage(spark):
    import random

    rows = rows_of(random.Random(8), 150) + [(c, t, None if t == 3 else "user", None if t == 4 else "Fine.") for c in range(20, 24) for t in range(9)]
    made = C.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, damaged(rows)))


def test_inserted_rows_are_written(spark):
    """Where deleting is dear, missing turns are inserted, also between the copies of a row."""
    grammar = C.role_grammar(C.Costs(rerole=9, delete=9, insert=1, truncated=1))
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (2, 0, "assistant", "C."), (3, 0, "system", "D.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = C.repair(df, grammar=grammar)
    turns = {}
    for r in found.turns.collect():
        turns.setdefault(r["conv"], []).append(f"{r['role'][0]}:{r['text']}")
    assert turns == {1: ["u:A.", "a:", "u:B.", "a:"], 2: ["u:", "a:C."], 3: ["s:D.", "u:", "a:"]}
    assert {r["conv"]: (r["cost"], r["audit"]) for r in found.report.collect()} == {1: (2, "KIKI"), 2: (1, "IK"), 3: (2, "KII")}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    found = C.repair(empty)
    assert found.report.count() == 0 and C.digests(found.turns).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "assistant", "B.")], empty.schema).selectExpr("*", "1 AS conv", "2 AS digest", "3 AS copies")
    assert [r["audit"] for r in C.repair(df).report.collect()] == ["KK"]
