"""Repair of conversation structure by error-correcting Earley parsing.

The roles of a sound conversation follow a grammar.  Rows are kept, reroled or deleted and rows are inserted, each at a cost; the
cheapest repair wins, of equal ones that whose audit (the letters K, R, D and I of its edits, in order) is least.

The role grammar is left-linear and is read from the last row to the first, so that an item's audit grows at its front and the
least audit of an item is always part of the least audit of the whole.  Edits are productions of their own (``Grammar.of``).  A
chart holds for each column one value for each nonterminal, the least (cost, audit): all items begin at the first column, so a
parse takes one step for each row.

Conversations are not held whole.  Rows are range-sorted and cut into segments of at most ``SEGMENT`` rows, which are parsed from
every nonterminal; a conversation's segments are then joined from the last to the first.  Texts are read twice and moved once: the
parse needs only their digests and faults, and the edits meet the texts in the order of the rows.

Order: by turn (nulls first), then role, then the SHA-256 of the text.  Null roles and texts are one space.  A null conversation id
is an id of its own.  Equal rows are counted, not moved one by one; all but the first are duplicates.  Very long texts are digested
whole.  An empty table gives empty results.  Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import groups, store

SEGMENT = 1024
#: Symbols of a row: its role's initial, or ``OTHER``; upper case where it is truncated; ``FAULTY`` where it must be deleted.
OTHER, FAULTY = "o", "x"
Value = tuple[int, str, str]


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass(frozen=True)
class Production:
    """``left`` derives ``first`` followed by the terminal ``then`` (none: the edit reads no row)."""

    left: str
    first: str
    then: str | None
    cost: int
    letter: str
    role: str


@dataclass(frozen=True)
class Grammar:
    """A left-linear grammar over rows read from the last to the first."""

    start: str
    accepted: frozenset[str]
    productions: tuple[Production, ...]
    after: dict[str, list[Production]] = field(default_factory=dict, compare=False, hash=False)

    @classmethod
    def of(cls, rules: Iterable[tuple[str, str, str]], start: str, accepted: Iterable[str], roles: dict[str, str], costs: Costs = Costs()) -> Grammar:
        """The grammar of ``rules`` (left, first, role initial) with productions that delete any row, and rerole rows to or insert rows of ``roles`` (by initial)."""
        rules = list(rules)
        initials = sorted({t for _, _, t in rules})
        found = []
        for left, first, t in rules:
            for seen in [*initials, OTHER]:
                for symbol, more in ((seen, 0), (seen.upper(), costs.truncated)):
                    if seen == t:
                        found.append(Production(left, first, symbol, more, "K", t))
                    elif t in roles:
                        found.append(Production(left, first, symbol, more + costs.rerole, "R", t))
            if t in roles:
                found.append(Production(left, first, None, costs.insert, "I", t))
        for name in {start, *(x for r in rules for x in r[:2])}:
            for symbol in [FAULTY, *initials, OTHER, *(x.upper() for x in [*initials, OTHER])]:
                found.append(Production(name, name, symbol, costs.delete, "D", "-"))
        grammar = cls(start, frozenset(accepted), tuple(found))
        for p in found:
            grammar.after.setdefault(p.first, []).append(p)
        return grammar

    @property
    def nonterminals(self) -> list[str]:
        return sorted({self.start, *(p.left for p in self.productions)})

    @property
    def legal_pairs(self) -> set[str]:
        """Initials that may follow one another."""
        kept = [p for p in self.productions if p.letter == "K"]
        return {q.role + p.role for p in kept for q in kept if q.first == p.left}


#: ``(system? (user assistant)+)?``, each nonterminal named by what the rows read so far begin with.
ROLES = {"u": "user", "a": "assistant"}
TURNS = [("assistant", "end", "a"), ("assistant", "user", "a"), ("user", "assistant", "u"), ("system", "user", "s")]


def role_grammar(costs: Costs = Costs()) -> Grammar:
    return Grammar.of(TURNS, "end", ("end", "user", "system"), ROLES, costs)


def parse(grammar: Grammar, symbols: str, seed: str) -> dict[str, Value]:
    """The least (cost, audit, roles) of each nonterminal over ``symbols``, which stand in the order of the rows and are read from the last, if what follows them derives from ``seed``."""
    column = complete(grammar, {seed: (0, "", "")})
    for symbol in reversed(symbols):
        scanned: dict[str, Value] = {}
        for name, value in column.items():  # predicted items, one row ahead
            for p in grammar.after.get(name, ()):
                if p.then == symbol:
                    new = advance(p, value)
                    if p.left not in scanned or new < scanned[p.left]:
                        scanned[p.left] = new
        column = complete(grammar, scanned)
    return column


def advance(p: Production, value: Value) -> Value:
    return value[0] + p.cost, p.letter + value[1], p.role + value[2]


def complete(grammar: Grammar, column: dict[str, Value]) -> dict[str, Value]:
    """The column with all that insertions derive from it, least values first."""
    agenda, done = [(value, name) for name, value in column.items()], {}
    heapq.heapify(agenda)
    while agenda:
        value, name = heapq.heappop(agenda)
        if name not in done:
            done[name] = value
            for p in grammar.after.get(name, ()):
                if p.then is None and p.left not in done:
                    heapq.heappush(agenda, (advance(p, value), p.left))
    return done


def faults(text: Column) -> tuple[Column, Column]:
    """(has no visible character, last one ends no sentence)."""
    last = F.substring(F.rtrim(text, F.lit(" \t\n\v\f\r")), -1, 1)
    return last == "", (last != "") & ~last.isin(".", "!", "?")


def _normal(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    return named.withColumn("digest", groups.sha256(F.col("text")))


def row_facts(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, copies, blank, truncated, repeated) of the distinct rows: what the parse reads instead of texts."""
    blank, cut = faults(F.col("text"))
    slim = rows.withColumn("blank", blank).withColumn("truncated", cut).groupBy("conv", "turn", "role", "digest", "blank", "truncated").agg(F.count("*").alias("copies"))
    keyed = slim.withColumn("_salt", groups.salt(F.col("turn")))
    earliest = F.min(F.struct(F.col("turn").isNotNull(), F.col("turn")))
    first = groups.partial_then_total(keyed, ["conv", "role", "digest"], {"first": earliest}, {"first": F.min("first")})
    first = first.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("_salt").alias("_s"), F.col("first.turn").alias("_first"))
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")) & (F.col("_salt") == F.col("_s"))
    return keyed.join(first, same).select(*slim.columns, (~F.col("turn").eqNullSafe(F.col("_first"))).alias("repeated"))


def symbols_of(row: dict, grammar_initials: str) -> str:
    initial = row["role"][:1]
    symbol = initial if initial and initial in grammar_initials else OTHER
    first = FAULTY if row["blank"] or row["repeated"] else symbol.upper() if row["truncated"] else symbol
    return first + FAULTY * (row["copies"] - 1)


def _segments(facts: DataFrame, grammar: Grammar, size: int) -> DataFrame:
    """A row for each run of at most ``size`` rows of a conversation: its place, counts, the parses from every nonterminal, and what names its rows."""
    kinds = {f.name: f.dataType.simpleString() for f in facts.schema.fields}
    initials = "".join(sorted({p.role for p in grammar.productions} - {"-"}))
    legal = grammar.legal_pairs
    types = facts.select("conv", "turn", "role", "digest", "copies").schema
    arrow = [pa.field(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in types.fields]
    path = pa.struct([("seed", pa.string()), ("name", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])
    out = pa.schema(
        [arrow[0], pa.field("part", pa.int32()), pa.field("number", pa.int64())]
        + [pa.field(n, pa.int64()) for n in COUNTS]
        + [arrow[1].with_name("first_turn"), arrow[1].with_name("last_turn"), pa.field("first_role", pa.string()), pa.field("last_role", pa.string())]
        + [pa.field("paths", pa.list_(path)), pa.field("rows", pa.list_(pa.struct(arrow[1:])))]
    )

    def made(rows: list[dict], part: int, number: int, parses) -> dict:
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        symbols = "".join(symbols_of(r, initials) for r in rows)
        pairs = zip((r["role"][:1] for r in rows), (r["role"][:1] for r in rows[1:]), strict=False)
        paths = [dict(zip(("seed", "name", "cost", "audit", "roles"), (seed, *flat), strict=True)) for seed, *found in parses(symbols) for flat in found]
        return {
            "conv": rows[0]["conv"], "part": part, "number": number,
            "blank": sum(r["copies"] for r in rows if r["blank"]),
            "duplicate": sum(r["copies"] - (not r["repeated"]) for r in rows if not r["blank"]),
            "truncated": sum(r["truncated"] and not r["repeated"] for r in rows),
            "illegal": sum(a + b not in legal for a, b in pairs) + sum((r["copies"] - 1) * (2 * r["role"][:1] not in legal) for r in rows),
            "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "first_role": rows[0]["role"][:1], "last_role": rows[-1]["role"][:1], "paths": paths, "rows": rows,
        }

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parses = functools.lru_cache(50_000)(lambda symbols: [(seed, *_flat(parse(grammar, symbols, seed))) for seed in grammar.nonterminals])
        part, number, run, length = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if run and (row["conv"] != run[0]["conv"] or length >= size):
                    ready.append(made(run, part, number, parses))
                    run, length, number = [], 0, number + 1
                room = size - length
                while row["copies"] > room:  # a row of very many copies fills segments of its own
                    ready.append(made([*run, row | {"copies": room}], part, number, parses))
                    row = row | {"copies": row["copies"] - room, "repeated": True}
                    run, length, number, room = [], 0, number + 1, size
                run.append(row)
                length += row["copies"]
            if ready:
                yield pa.RecordBatch.from_pylist(ready, out)
        if run:
            yield pa.RecordBatch.from_pylist([made(run, part, number, parses)], out)

    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = facts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    counts = ", ".join(f"{n} bigint" for n in COUNTS)
    ddl = f"conv {kinds['conv']}, part int, number bigint, {counts}, first_turn {kinds['turn']}, last_turn {kinds['turn']}, first_role string, last_role string, "
    ddl += "paths array<struct<seed: string, name: string, cost: bigint, audit: string, roles: string>>, "
    return ordered.mapInArrow(cut, ddl + f"rows array<struct<turn: {kinds['turn']}, role: string, digest: binary, copies: bigint>>")


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _flat(column: dict[str, Value]) -> list[tuple]:
    return [(name, *value) for name, value in column.items()]


class Rope:
    """A sequence of (audit, roles) pieces, built at its front and sharing its ends; the first piece that differs decides the order."""

    __slots__ = ("piece", "rest")

    def __init__(self, piece: tuple[str, str], rest: Rope | None):
        self.piece, self.rest = piece, rest

    def letters(self, which: int) -> Iterator[str]:
        at: Rope | None = self
        while at is not None:
            yield at.piece[which]
            at = at.rest


def before(a: Rope | None, b: Rope | None) -> bool:
    """Whether the audit of ``a`` (then its roles) is less than that of ``b``."""
    for which in (0, 1):
        x, y, one, two = "", "", a, b
        while True:
            if one is two and x == y:
                break  # the same end
            if not x and one is not None:
                x, one = one.piece[which], one.rest
                continue
            if not y and two is not None:
                y, two = two.piece[which], two.rest
                continue
            if not x or not y:
                if x or y:
                    return not x
                break
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            x, y = x[n:], y[n:]
    return False


def join_segments(grammar: Grammar, segments: list[dict]) -> tuple[int, list[dict]]:
    """(cost, [(number, audit, roles) of each segment]) of a conversation whose segments come from the last to the first."""
    best: dict[str, tuple[int, Rope | None]] = {grammar.start: (0, None)}
    for segment in segments:
        new: dict[str, tuple[int, Rope | None]] = {}
        for path in segment["paths"]:
            if path["seed"] in best:
                cost, rest = best[path["seed"]]
                value = cost + path["cost"], Rope((path["audit"], path["roles"]), rest)
                old = new.get(path["name"])
                if old is None or value[0] < old[0] or (value[0] == old[0] and before(value[1], old[1])):
                    new[path["name"]] = value
        best = new
    chosen: tuple[int, Rope | None] | None = None
    for name in grammar.accepted & best.keys():
        value = best[name]
        if chosen is None or value[0] < chosen[0] or (value[0] == chosen[0] and before(value[1], chosen[1])):
            chosen = value
    assert chosen is not None  # all rows can be deleted
    rope, out = chosen[1], []
    for segment in reversed(segments):
        out.append({"part": segment["part"], "number": segment["number"], "audit": rope.piece[0], "roles": rope.piece[1]})
        rope = rope.rest
    return chosen[0], out


def _joined(segments: DataFrame, grammar: Grammar) -> DataFrame:
    """(conv, cost, counts, chosen) of every conversation; segments stream in order, and only their parses are held."""
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    legal = grammar.legal_pairs
    conv = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds["conv"]]
    piece = pa.struct([("part", pa.int32()), ("number", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])
    out = pa.schema([("conv", conv), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("chosen", pa.list_(piece))])

    def made(own: list[dict]) -> dict:
        cost, chosen = join_segments(grammar, own)
        own = own[::-1]
        row = {n: sum(s[n] for s in own) for n in COUNTS}
        row["illegal"] += sum(a["last_role"] + b["first_role"] not in legal for a, b in zip(own, own[1:], strict=False))
        seen = [s for s in own if s["first_turn"] is not None]
        turns = row.pop("turns") - sum(a["last_turn"] == b["first_turn"] for a, b in zip(seen, seen[1:], strict=False))
        gaps = seen[-1]["last_turn"] - seen[0]["first_turn"] + 1 - turns if seen else 0
        return row | {"conv": own[0]["conv"], "gaps": gaps, "cost": cost, "audit": "".join(c["audit"] for c in chosen), "chosen": chosen}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for batch in batches:
            ready = []
            for segment in batch.to_pylist():
                if own and own[0]["conv"] != segment["conv"]:
                    ready.append(made(own))
                    own = []
                own.append(segment)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, out)
        if own:
            yield pa.RecordBatch.from_pylist([made(own)], out)

    ddl = f"conv {kinds['conv']}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    dealt = segments.drop("rows").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.desc("part"), F.desc("number"))
    return dealt.mapInArrow(join, ddl + "chosen array<struct<part: int, number: bigint, audit: string, roles: string>>")


def _edits(segments: DataFrame, joined: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, before, new_role, after): for each row that stays or has rows inserted beside it, its new role (null: deleted) and the roles of those."""
    chosen = joined.select(F.explode("chosen").alias("c")).select("c.*").withColumnsRenamed({"part": "_part", "number": "_number"})
    rows = segments.select("conv", "part", "number", "rows").join(chosen, (F.col("part") == F.col("_part")) & (F.col("number") == F.col("_number")))
    kinds = {f.name: f.dataType.simpleString() for f in segments.select("conv", F.col("rows")[0]["turn"].alias("turn")).schema.fields}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names = pa.list_(pa.string())
    out = pa.schema([("conv", arrow[kinds["conv"]]), ("turn", arrow[kinds["turn"]]), ("role", pa.string()), ("digest", pa.binary()), ("before", names), ("new_role", pa.string()), ("after", names)])

    def edited(segment: dict) -> Iterator[dict]:
        letters, at = list(zip(segment["audit"], segment["roles"], strict=True)), 0
        for i, row in enumerate(segment["rows"]):
            found = {n: row[n] for n in ("turn", "role", "digest")} | {"conv": segment["conv"], "before": [], "new_role": None, "after": []}
            left = row["copies"]
            while at < len(letters) and (left or i == len(segment["rows"]) - 1):
                letter, role = letters[at]
                at += 1
                if letter == "I":
                    found["after" if found["new_role"] is not None else "before"].append(ROLES[role])
                else:
                    left -= 1
                    if letter != "D":
                        found["new_role"] = row["role"] if letter == "K" else ROLES[role]
            if found["new_role"] is not None or found["before"]:
                yield found

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [e for s in batch.slice(i, 1).to_pylist() for e in edited(s)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, out)

    ddl = f"conv {kinds['conv']}, turn {kinds['turn']}, role string, digest binary, before array<string>, new_role string, after array<string>"
    return rows.select("conv", "rows", "audit", "roles").mapInArrow(expand, ddl)


def _repaired(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, place, role, text) of every repaired conversation: its rows follow one another in one partition, in order."""
    names = ["conv", "turn", "role", "digest"]
    kind = rows.schema["conv"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = pa.schema([("conv", arrow), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("before", "array<string>"), ("new_role", "string"), ("after", "array<string>"))]
    both = edits.select(*names, F.lit(0).alias("side"), "before", "new_role", "after", F.lit(None).cast("string").alias("text"))
    both = both.union(rows.select(*names, F.lit(1).alias("side"), *nothing, "text"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "side"]
    dealt = both.repartition("conv").sortWithinPartitions(*order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edit, conv, place = None, (), 0
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if (row["conv"],) != conv:
                    conv, place = (row["conv"],), 0
                same = edit is not None and all(edit[n] == row[n] for n in names)
                if row["side"] == 0 and same:  # copies of one row in two segments; those in the second are deleted
                    edit["after"] += row["before"] + row["after"]
                elif row["side"] == 0:
                    edit = row
                elif same:
                    kept = [(edit["new_role"], row["text"])] if edit["new_role"] is not None else []
                    for role, text in [*((r, "") for r in edit["before"]), *kept, *((r, "") for r in edit["after"])]:
                        ready.append({"conv": row["conv"], "place": place, "role": role, "text": text})
                        place += 1
                    edit = None
            if ready:
                yield pa.RecordBatch.from_pylist(ready, out)

    return dealt.mapInArrow(merge, f"conv {kind}, place bigint, role string, text string")


@dataclass(frozen=True)
class Repair:
    """``report``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows.
    ``turns``: (conv, place, role, text) of the repaired conversations, each in one partition and in order."""

    report: DataFrame
    turns: DataFrame


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", grammar: Grammar | None = None, segment: int = SEGMENT
) -> Repair:
    """The cheapest repair of every conversation of ``rows``; conversation ids and turns are integers (ids may be strings)."""
    grammar = grammar or role_grammar()
    store.bound_batches(rows.sparkSession)
    named = _normal(rows, conv, turn, role, text)
    facts = store.Scratch(rows.sparkSession)
    segments = store.table(_segments(facts.table(row_facts(named), "row-facts"), grammar, segment), "segments")
    facts.drop("row-facts")
    joined = store.table(_joined(segments, grammar), "joined-segments")
    return Repair(joined.drop("chosen"), _repaired(_edits(segments, joined), named))


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of ``role:text`` of a repaired conversation's rows, joined by newlines.

    SHA-256 reads its input in order, so a conversation is one task's work; it streams by and is never held."""
    kind = turns.schema["conv"].dataType.simpleString()
    out = pa.schema([("conv", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = (), hashlib.sha256()
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if (row["conv"],) != conv:
                    if conv:
                        ready.append({"conv": conv[0], "sha256": state.hexdigest()})
                    conv, state = (row["conv"],), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{row['role']}:{row['text']}".encode())
            if ready:
                yield pa.RecordBatch.from_pylist(ready, out)
        if conv:
            yield pa.RecordBatch.from_pylist([{"conv": conv[0], "sha256": state.hexdigest()}], out)

    return turns.mapInArrow(digest, f"conv {kind}, sha256 string")


def damage(rows: DataFrame, modulus: int = 20) -> DataFrame:
    """Conversations with faults set by crc32 of ``conv_id:turn``: rows dropped, emptied, without sentence ends, doubled or said by the user."""
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat_ws(":", blank["conv_id"], blank["turn"]).cast("binary")) % modulus
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank["text"], ".!?", "")).otherwise(blank["text"])
    role = F.when(kind == 4, "user").otherwise(blank["role"])
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(True), copies)))
    return made.drop("col")
