"""A corpus of evidence under stable keys and ids, and cases that name its records by key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import ids

#: Kinds whose key is the kind alone: there is one record of them.
SINGLE = ("profile",)


def record_key(kind: Column, label: Column, aliases: dict[str, dict[str, str]] | None = None) -> Column:
    """``kind:label``, or the kind alone for those of which there is one.

    ``aliases`` gives for a kind the names that its labels hold: a label is known by the first name in it, as labels also tell dates and
    roles; a label without any is an error that names it."""
    key = F.when(kind.isin(*SINGLE), kind).otherwise(F.concat_ws(":", kind, F.coalesce(label, F.lit(""))))
    for name, found in (aliases or {}).items():
        by_name = F.raise_error(F.concat(F.lit("no key for evidence: "), F.coalesce(label, F.lit("")))).cast("string")
        for part, alias in reversed(found.items()):
            by_name = F.when(F.contains(label, F.lit(part)), F.lit(f"{name}:{alias}")).otherwise(by_name)
        key = F.when(kind == name, by_name).otherwise(key)
    return key


def corpus(evidence: DataFrame, kind: str, label: str, namespace: uuid.UUID, aliases: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """The evidence with ``key`` and ``record_id``, the name-based id of its key: the same in every run, on every machine.

    Keys are unique: one that comes twice is an error that names it.  Rows are counted by key before they are joined, so a key
    that many rows share costs no more than another."""
    keyed = evidence.withColumn("key", record_key(F.col(kind), F.col(label), aliases))
    twice = keyed.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("key").alias("_k"))
    checked = keyed.join(twice, F.col("key") == F.col("_k"), "left")
    sound = F.when(F.col("_k").isNotNull(), F.raise_error(F.concat(F.lit("evidence keys must be unique: "), F.col("key"))).cast("string")).otherwise(F.col("key"))
    return checked.withColumn("key", sound).drop("_k").withColumn("record_id", ids.uuid5(namespace, F.col("key")))


def resolve(cases: DataFrame, records: DataFrame, case: str, keys: str) -> DataFrame:
    """(case, position, key, record_id): the keys that each case names, in order, with the records behind them; null where the corpus has none."""
    named = cases.select(case, F.posexplode(keys).alias("position", "key"))
    return named.join(records.select("key", "record_id"), "key", "left").select(case, F.col("position").cast("bigint").alias("position"), "key", "record_id")


def keys_of(found: DataFrame, records: DataFrame, record_id: str) -> DataFrame:
    """Rows that hold record ids with the keys of those records."""
    return found.join(records.select(F.col("record_id").alias(record_id), "key"), record_id, "left")
