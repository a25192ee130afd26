"""Records with nested sections: one payload becomes a root row and the rows of its child tables, and partial payloads update them.

A section is an array of structs.  In a partial payload null means "leave it as it is", for fields of the root and for sections; an
empty array clears its section.  Children get name-based ids from their parent, section and place, so a task that runs twice gives the
same rows.  Every child table is replaced by one anti-join on the parents whose payload names the section.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import ids


@dataclass(frozen=True)
class Shape:
    """``key`` and ``owner`` of the root, its own ``fields``, the ``sections`` by name, and the namespace of the children's ids."""

    key: str
    owner: str
    fields: tuple[str, ...]
    sections: tuple[str, ...]
    namespace: uuid.UUID = uuid.NAMESPACE_OID


@dataclass(frozen=True)
class Tables:
    root: DataFrame
    children: dict[str, DataFrame]


def child_id(shape: Shape, section: str, position: Column) -> Column:
    return ids.uuid5(shape.namespace, F.concat_ws(":", F.col(shape.key).cast("string"), F.lit(section), position.cast("string")))


def section_rows(payloads: DataFrame, shape: Shape, section: str) -> DataFrame:
    """(record_id, key, position, the section's fields): a row for each record of a section, in its order; records that are null are left out."""
    rows = payloads.select(shape.key, F.posexplode(section).alias("position", "_record")).filter("_record is not null")
    return rows.select(child_id(shape, section, F.col("position")).alias("record_id"), shape.key, F.col("position").cast("bigint").alias("position"), "_record.*")


def create(payloads: DataFrame, shape: Shape) -> Tables:
    """The root table and a table for each section, from one read of the payloads."""
    root = payloads.select(shape.key, shape.owner, *shape.fields)
    return Tables(root, {s: section_rows(payloads, shape, s) for s in shape.sections})


def admitted(tables: Tables, payloads: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """(payloads whose root is there and belongs to who sends them, the keys of the others): nobody learns whether a record of another owner exists."""
    held = tables.root.select(F.col(shape.key).alias("_key"), F.col(shape.owner).alias("_owner"))
    same = (F.col(shape.key) == F.col("_key")) & (F.col(shape.owner) == F.col("_owner"))
    return payloads.join(held, same, "left_semi"), payloads.join(held, same, "left_anti").select(shape.key)


def update(tables: Tables, payloads: DataFrame, shape: Shape) -> tuple[Tables, DataFrame]:
    """(the tables after partial payloads, (table, updated, deleted, inserted)); payloads for records of others change nothing.

    Each root has one payload at most."""
    own, _ = admitted(tables, payloads, shape)
    sent = own.select(F.col(shape.key).alias("_key"), *(F.col(f).alias(f"_new_{f}") for f in shape.fields))
    joined = tables.root.join(sent, F.col(shape.key) == F.col("_key"), "left")
    changes = reduce(lambda a, b: a | b, (F.col(f"_new_{f}").isNotNull() & ~F.col(f"_new_{f}").eqNullSafe(F.col(f)) for f in shape.fields), F.lit(False))
    root = joined.select(shape.key, shape.owner, *(F.coalesce(f"_new_{f}", f).alias(f) for f in shape.fields))
    counts = [joined.agg(F.lit("root").alias("table"), F.count_if(changes).alias("updated"), F.lit(0).cast("bigint").alias("deleted"), F.lit(0).cast("bigint").alias("inserted"))]
    children = {}
    for section in shape.sections:
        named = own.filter(F.col(section).isNotNull())
        keys, old, new = named.select(shape.key), tables.children[section], section_rows(named, shape, section)
        children[section] = old.join(keys, shape.key, "left_anti").unionByName(new)
        zero = F.lit(0).cast("bigint")
        counts.append(old.join(keys, shape.key, "left_semi").agg(F.lit(section).alias("table"), zero.alias("updated"), F.count("*").alias("deleted"), zero.alias("inserted")))
        counts.append(new.agg(F.lit(section).alias("table"), zero.alias("updated"), zero.alias("deleted"), F.count("*").alias("inserted")))
    total = reduce(DataFrame.unionByName, counts).groupBy("table").agg(*(F.sum(n).alias(n) for n in ("updated", "deleted", "inserted")))
    return Tables(root, children), total


def delete(tables: Tables, doomed: DataFrame, shape: Shape) -> Tables:
    """The tables without some roots, given by (key, owner), and all that they own."""
    own, _ = admitted(tables, doomed, shape)
    keys = own.select(shape.key)
    return Tables(tables.root.join(keys, shape.key, "left_anti"), {s: t.join(keys, shape.key, "left_anti") for s, t in tables.children.items()})


def read(tables: Tables, shape: Shape) -> DataFrame:
    """Each root with its sections as arrays in their order, empty where there is nothing: what ``create`` took.

    All tables meet in one shuffle on the key."""
    fields = {s: [c for c in t.columns if c not in ("record_id", shape.key)] for s, t in tables.children.items()}
    kinds = {s: f"array<{t.select(F.struct(*fields[s]).alias('s')).schema['s'].dataType.simpleString()}>" for s, t in tables.children.items()}
    none = [F.lit(None).cast(k.removeprefix("array<")[:-1]).alias(s) for s, k in kinds.items()]
    parts = [tables.root.select(shape.key, F.struct(shape.owner, *shape.fields).alias("_root"), *none)]
    kind = parts[0].schema["_root"].dataType.simpleString()
    for at, (section, table) in enumerate(tables.children.items()):
        own = [F.struct(*fields[section]).alias(section) if i == at else n for i, n in enumerate(none)]
        parts.append(table.select(shape.key, F.lit(None).cast(kind).alias("_root"), *own))
    every = reduce(DataFrame.union, parts).groupBy(shape.key)
    found = every.agg(F.max("_root").alias("_root"), *(F.array_sort(F.collect_list(s)).alias(s) for s in shape.sections)).filter("_root is not null")
    bare = [F.transform(s, _without_place(fields[s])).alias(s) for s in shape.sections]
    return found.select(shape.key, "_root.*", *bare)


def _without_place(names: list[str]):
    return lambda x: F.struct(*(x[n].alias(n) for n in names if n != "position"))
