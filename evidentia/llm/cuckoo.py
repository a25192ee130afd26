"""Exact deduplication over a sharded cuckoo-filter index of live digests.

Two texts are equal when they are identical after lower-casing A-Z; null counts as the empty text.  Of equal texts the
row with the largest id stays.

The index is a table with one row for each shard of the digest space.  A shard holds

* the filter: buckets of four 16-bit fingerprints.  A digest may lie in two buckets, the second of which follows from the
  first and the fingerprint (partial-key cuckoo hashing), so that entries can be moved and deleted without their key;
* the bucketed content: for each slot the whole SHA-256 digest with its payload.  A fingerprint that hits is only believed
  when the content of its slot is the same digest, so no result rests on a fingerprint;
* an overflow rule: when an insertion finds no place after ``MAX_KICKS`` moves, the shard doubles its buckets and is
  filled again from the stored digests.

Rows reach the index as (digest, salt) groups that were aggregated before the shuffle, so a text with billions of copies
arrives as ``groups.SALTS`` entries, and a shard sees each of its digests that often at most.  Only digests are moved, never
texts.  The number of shards follows the number of entries (``shards_for``), so a shard always fits in one task.

Very long texts are digested whole, in the engine.  Extra columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import groups, store

SLOTS = 4
MAX_KICKS = 200
#: One row for each shard: fingerprints in slot order (0: free), then the content of the used slots in the same order.
INDEX_SCHEMA = "shard int, buckets int, fingerprints binary, digests binary, keep_ids array<bigint>, counts array<bigint>"
#: What an insertion reports for each entry.
REPORT = "digest binary, keep_id bigint, group_size bigint, salts array<int>"


def digest(text: Column) -> Column:
    """SHA-256 of each text after lower-casing A-Z, in 32 bytes."""
    return groups.sha256(groups.lower_ascii(text))


class CuckooIndex:
    """The live digests of one shard."""

    def __init__(self, buckets: int = 64):
        self.live: int = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets  # a power of two
        self.fingerprints = [0] * (buckets * SLOTS)
        self.content: list[list | None] = [None] * (buckets * SLOTS)  # [digest, largest id, copies]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """(fingerprint, first bucket, second bucket)."""
        fingerprint = int.from_bytes(key[-2:], "big") or 1
        first = int.from_bytes(key[-10:-2], "big") & (self.buckets - 1)
        return fingerprint, first, self._other(first, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995)) & (self.buckets - 1)

    def find(self, key: bytes) -> int:
        """The slot of a digest, or -1: fingerprints first, the stored digest decides."""
        fingerprint, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.fingerprints[slot] == fingerprint and self.content[slot][0] == key:
                    return slot
        return -1

    def _place(self, entry: list) -> list | None:
        """Put an entry that isn't there into a free slot, moving others; what is left over if none is found."""
        fingerprint, bucket, second = self._places(entry[0])
        for kick in range(MAX_KICKS):
            for at in (bucket, second):
                for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                    if not self.fingerprints[slot]:
                        self.fingerprints[slot], self.content[slot] = fingerprint, entry
                        return None
            slot = (second if kick % 2 else bucket) * SLOTS + (fingerprint + kick) % SLOTS
            victim = self.content[slot]
            self.fingerprints[slot], self.content[slot] = fingerprint, entry
            entry = victim
            fingerprint, bucket, second = self._places(entry[0])
        return entry

    def insert(self, key: bytes, keep_id: int | None, copies: int) -> int:
        """Add copies of a digest; its slot is only good until the next insertion."""
        slot = self.find(key)
        if slot >= 0:
            entry = self.content[slot]
            entry[1] = max((x for x in (entry[1], keep_id) if x is not None), default=None)
            entry[2] += copies
            return slot
        self.live += 1
        left = self._place([key, keep_id, copies])
        while left is not None:
            left = self._resize(left)
        return self.find(key)

    def _resize(self, extra: list) -> list | None:
        entries = [x for x in self.content if x is not None] + [extra]
        self._empty(self.buckets * 2)
        for i, entry in enumerate(entries):
            left = self._place(entry)
            if left is not None:
                return self._resize_with([left, *entries[i + 1 :]])
        return None

    def _resize_with(self, rest: list[list]) -> None:
        for extra in rest:
            left = self._place(extra)
            while left is not None:
                left = self._resize(left)

    def delete(self, key: bytes) -> bool:
        """Take a digest out with all its copies; False if it isn't live."""
        slot = self.find(key)
        if slot < 0:
            return False
        self.fingerprints[slot], self.content[slot] = 0, None
        self.live -= 1
        return True

    def entries(self) -> Iterator[list]:
        return (x for x in self.content if x is not None)

    def to_row(self, shard: int) -> dict:
        used = list(self.entries())
        return {
            "shard": shard,
            "buckets": self.buckets,
            "fingerprints": np.array(self.fingerprints, ">u2").tobytes(),
            "digests": b"".join(x[0] for x in used),
            "keep_ids": [x[1] for x in used],
            "counts": [x[2] for x in used],
        }

    @classmethod
    def from_row(cls, row) -> CuckooIndex:
        index = cls(int(row.buckets))
        index.fingerprints = np.frombuffer(row.fingerprints, ">u2").tolist()
        for i, slot in enumerate(np.flatnonzero(np.frombuffer(row.fingerprints, ">u2"))):
            keep = row.keep_ids[i]
            index.content[slot] = [row.digests[32 * i : 32 * i + 32], None if pd.isna(keep) else int(keep), int(row.counts[i])]
            index.live += 1
        return index


def shard_of(digest_col: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest_col, 1, 7)), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def shards_for(entries: int, per_shard: int = 50_000) -> int:
    return max(16, -(-entries // per_shard))


def entries_of(rows: DataFrame) -> DataFrame:
    """(digest, salt, keep_id, copies): rows (digest, _salt, _id) counted for each digest and salt, before anything else is moved."""
    return rows.groupBy("digest", F.col("_salt").alias("salt")).agg(F.max("_id").alias("keep_id"), F.count("*").alias("copies"))


def _load(index_pdf: pd.DataFrame | None) -> CuckooIndex:
    return CuckooIndex() if index_pdf is None or index_pdf.empty else CuckooIndex.from_row(index_pdf.iloc[0])


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX_SCHEMA)


def _sharded(entries: DataFrame, shards: int) -> DataFrame:
    return entries.withColumn("shard", shard_of(F.col("digest"), shards)).groupBy("shard")


def insert(index: DataFrame, entries: DataFrame, shards: int) -> DataFrame:
    """The index after the entries (``entries_of``) went in; ``shards`` stays the same through the life of an index."""

    def into(key: tuple, held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        state = _load(held)
        for row in new.itertuples():
            state.insert(bytes(row.digest), None if pd.isna(row.keep_id) else int(row.keep_id), int(row.copies))
        return pd.DataFrame([state.to_row(int(key[0]))])

    return index.groupBy("shard").cogroup(_sharded(entries, shards)).applyInPandas(into, INDEX_SCHEMA)


def delete(index: DataFrame, digests: DataFrame, shards: int) -> DataFrame:
    """The index without the digests of the column ``digest``; unknown ones change nothing."""

    def out_of(key: tuple, held: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        state = _load(held)
        for value in gone.digest:
            state.delete(bytes(value))
        return pd.DataFrame([state.to_row(int(key[0]))])

    return index.groupBy("shard").cogroup(_sharded(digests.select("digest").distinct(), shards)).applyInPandas(out_of, INDEX_SCHEMA)


def probe(index: DataFrame, entries: DataFrame, shards: int) -> DataFrame:
    """For each digest of the entries: its keeper and live copies in the index (null and 0 if it isn't live), and its salts."""

    def look(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        state, salts = _load(held), {}
        for row in asked.itertuples():
            salts.setdefault(bytes(row.digest), []).append(int(row.salt))
        slots = [state.find(x) for x in salts]
        found = [state.content[slot] if slot >= 0 else [None, None, 0] for slot in slots]
        return pd.DataFrame(
            {
                "digest": pd.Series(list(salts), dtype=object),
                "keep_id": pd.array([x[1] for x in found], "Int64"),
                "group_size": pd.Series([x[2] for x in found], dtype="int64"),
                "salts": pd.Series(list(salts.values()), dtype=object),
            }
        )

    return index.groupBy("shard").cogroup(_sharded(entries, shards)).applyInPandas(look, REPORT)


def deduplicate(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, digest, keep_id, group_size, kept) for every row of ``df``, by building an index over all of it.

    Null texts count as empty.  A row with a null id keeps its place only where all equal rows have null ids; rows that
    repeat id and text are all reported and all kept or dropped alike.  An empty table gives an empty result.
    """
    store.bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("digest")).withColumn("_salt", groups.salt(F.col("_id")))
    rows = store.table(rows, "digests")
    entries = store.table(entries_of(rows), "entries")
    shards = shards_for(entries.count())
    index = store.table(insert(empty_index(df.sparkSession), entries, shards), "index")
    report = probe(index, entries, shards).withColumn("_salt", F.explode("salts")).drop("salts")
    kept = F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return rows.join(report, ["digest", "_salt"]).select(F.col("_id").alias(id_col), "digest", "keep_id", "group_size", kept)
