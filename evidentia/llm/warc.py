"""WARC archives: a deterministic sharded writer and its reader.

Writing.  Payload digests are regenerated from the bytes; of records with equal payloads of at least ``revisit_from`` bytes
the one with the smallest id is the response and the others revisit it.  Records are sorted by id in ranges: a histogram of
payload bytes over cells of the id range, refined where a cell is heavy, is cut into shards of about ``shard_bytes``.  The cut
depends on the data alone, so a rerun, or a run with other partitions, writes the same shards.  A shard is written in id order
by one task that keeps one record in memory; a file is rolled when its compressed size reaches ``roll_bytes``.  Both sizes grow
with the data (``MOST_SHARDS``), so that 100 TB are some hundred thousand files and not millions.  Headers are regenerated
(ids and dates come from the record, never from the clock).

Committing.  Files are written to a temporary folder under names that are unique to the task attempt; the manifest of all attempts that Spark took
is written as a table; then each file is renamed to its final name, the manifest is published, and the temporary folder is
deleted with what lost attempts left there.  Readers only read files in the manifest.

Reading.  Tasks take files of the manifest, each streamed record by record; a record whose payload or file whose size does not match
its digest raises an error.

Paths are URIs that ``pyarrow.fs`` opens (file, hdfs, s3, gs).  Rows without an id fill shards of their own in front, null payloads are empty, null urls are
written as an empty target.  Rows that repeat an id and its payload are all responses (or all revisits of a smaller id): types follow
from the id.  Very long payloads are one record like others.  An empty table gives a folder with an empty manifest.  Extra columns
of the input, whatever their names, are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import groups, store

SHARD_BYTES = 32 << 20
ROLLS = 4  # files of a shard, about
READ_BYTES, MOST_READERS = 8 << 20, 20_000
CELLS = 4096
LEVELS = 4
MOST_SHARDS = 50_000
DATE = "1970-01-01T00:00:00Z"
TEMPORARY = "_temporary"
MANIFEST = "shard int, seq int, temporary string, name string, bytes bigint, records bigint, sha256 string"
RECORD = "record_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def assign_types(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """(record_id, payload_bytes, payload_digest, refers_to) for every row of (record_id, payload).

    Equal payloads are equal digests and lengths; totals go back to the rows by (digest, salt), so no hot payload is a hot key."""
    rows = pages.select(
        "record_id", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint").alias("payload_bytes"), groups.base32_sha1(F.col("payload")).alias("payload_digest")
    ).withColumn("_salt", groups.salt(F.col("record_id")))
    rows = store.table(rows, "payload-digests")
    keys = ["payload_digest", "payload_bytes"]
    first = groups.partial_then_total(rows, keys, {"_first": F.min("record_id")}, {"_first": F.min("_first")})
    refers = F.when((F.col("payload_bytes") >= revisit_from) & ~F.col("record_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return rows.join(first, [*keys, "_salt"]).select("record_id", *keys, refers.alias("refers_to"))


def bounds_lookup(lows: list[int]):
    """A column function id -> number of the range it lies in; null ids are in the first."""
    starts = np.array(lows, np.int64)

    @F.arrow_udf(T.IntegerType())
    def place(ids: pa.Array) -> pa.Array:
        values = pc.fill_null(ids.cast(pa.int64()), int(starts[0])).to_numpy(zero_copy_only=False)
        return pa.array(np.maximum(np.searchsorted(starts, values, side="right") - 1, 0).astype(np.int32))

    return place


def cut_shards(typed: DataFrame, shard_bytes: int, most: int = MOST_SHARDS) -> list[int]:
    """The first ids of the shards of about ``shard_bytes``, ascending, from the data alone.

    A level counts bytes in ``CELLS`` cells of each range; cells above a quarter of a shard are the ranges of the next level.
    Shards are never smaller than the whole over ``most``, so ranges (at most four for each shard), the heavy cells among
    them and the result are lists of a bounded length.  The light cells stay in Spark until they are summed to shards."""
    sizes = typed.select("record_id", (F.col("payload_bytes") + 500).alias("b")).filter("record_id is not null")
    bounds = sizes.agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi"), F.sum("b").alias("b")).first()
    if bounds["lo"] is None:
        return [0]
    shard_bytes = max(shard_bytes, bounds["b"] // most)
    ranges, done = [(bounds["lo"], bounds["hi"] + 1)], None
    for level in range(LEVELS):
        widths = [max(1, -(-(high - low) // CELLS)) for low, high in ranges]
        lookup = bounds_lookup([low for low, _ in ranges])
        inside = sizes.withColumn("r", lookup("record_id"))
        limits = typed.sparkSession.createDataFrame([(i, lo, hi, w) for i, ((lo, hi), w) in enumerate(zip(ranges, widths, strict=True))], "r int, low bigint, high bigint, w bigint")
        inside = inside.join(F.broadcast(limits), "r").filter((F.col("record_id") >= F.col("low")) & (F.col("record_id") < F.col("high")))
        start = F.col("low") + F.floor((F.col("record_id") - F.col("low")) / F.col("w")) * F.col("w")
        cells = inside.groupBy(start.alias("start"), F.least(F.col("high"), start + F.col("w")).alias("stop")).agg(F.sum("b").alias("b"))
        cells = store.table(cells, "cells")
        heavy = (F.col("b") > shard_bytes // 4) & (F.col("stop") - F.col("start") > 1) & F.lit(level < LEVELS - 1)
        done = cells.filter(~heavy) if done is None else done.unionByName(cells.filter(~heavy))
        ranges = sorted((r["start"], r["stop"]) for r in cells.filter(heavy).collect())
        if not ranges:
            break
    # Prefix sums in two levels: cells are dealt to parts by range of start; only the sums of parts meet in one task.
    parts = store.table(done.repartitionByRange("start").withColumn("part", F.spark_partition_id()), "cell-parts")
    over_parts = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("part").agg(F.sum("b").alias("_b")).withColumn("_before", F.coalesce(F.sum("_b").over(over_parts), F.lit(0))).select("part", "_before")
    within = Window.partitionBy("part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("_before") + F.coalesce(F.sum("b").over(within), F.lit(0))
    shards = parts.join(F.broadcast(before), "part").withColumn("shard", F.floor(upto / F.lit(shard_bytes)))  # a row for each part
    return sorted(r["low"] for r in shards.groupBy("shard").agg(F.min("start").alias("low")).collect())


def header(kind: str, record_id, url: str, digest: str, size: int, refers_to) -> bytes:
    """The regenerated WARC header of a record, without its block."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"record:{record_id}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Record-Key: {'' if record_id is None else record_id}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{refers_to}')}>", f"X-Refers-To-Key: {refers_to}",
        ]
    return "\r\n".join(lines).encode()


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def record(kind: str, record_id, url: str, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    """One record as a gzip member; a revisit has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    more = f"\r\nContent-Type: application/http; msgtype=response\r\nWARC-Block-Digest: sha1:{base32_sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    whole = header(kind, record_id, url, digest, size, refers_to) + more.encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


class Roller:
    """Writes the records of one shard to files of about ``roll_bytes``, under names of this attempt."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.attempt = shard, roll_bytes, uuid.uuid4().hex
        self.done: list[dict] = []
        self.out = None

    def _open(self) -> None:
        self.temporary = f"{TEMPORARY}/{self.attempt}-{self.shard:06d}-{len(self.done):05d}.warc.gz"
        self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.bytes, self.records, self.sum = 0, 0, hashlib.sha256()

    def add(self, member: bytes) -> None:
        if self.out is None:
            self._open()
        self.out.write(member)
        self.sum.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            name = f"part-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            values = (self.shard, len(self.done), self.temporary, name, self.bytes, self.records, self.sum.hexdigest())
            self.done.append(dict(zip([x.split()[0] for x in MANIFEST.split(", ")], values, strict=True)))


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, shard_bytes: int | None = None, roll_bytes: int | None = None) -> str:
    """Write rows (record_id, url, payload) as archives to ``folder``; the path of the published manifest.

    Without sizes a shard has ``SHARD_BYTES`` or the whole over ``MOST_SHARDS``, and rolls about ``ROLLS`` files of them."""
    store.bound_batches(pages.sparkSession)
    spark = pages.sparkSession
    typed = store.table(assign_types(pages, revisit_from), "typed")
    if shard_bytes is None:
        shard_bytes = max(SHARD_BYTES, (typed.agg(F.sum("payload_bytes")).first()[0] or 0) // MOST_SHARDS)
    roll_bytes = roll_bytes or max(1, shard_bytes // ROLLS)
    starts = cut_shards(typed, shard_bytes)
    # rows without an id have no place in the range of ids: they fill shards of their own, in front, by digest
    unplaced = typed.filter("record_id is null").agg(F.sum(F.col("payload_bytes") + 500)).first()[0] or 0
    front = -(-unplaced // shard_bytes)
    by_digest = F.pmod(F.xxhash64("payload_digest"), F.lit(max(front, 1))).cast("int")
    # One shuffle brings each payload and, in front of it, its row of types to the writer of their shard.
    kinds = typed.dropDuplicates(["record_id", "payload_digest"]).withColumn("_order", F.lit(0))
    payloads = pages.select("record_id", "url", "payload", groups.base32_sha1(F.col("payload")).alias("payload_digest"), F.lit(1).alias("_order"))
    rows = kinds.unionByName(payloads, allowMissingColumns=True)
    rows = rows.withColumn("shard", F.when(F.col("record_id").isNull(), by_digest).otherwise(bounds_lookup(starts)("record_id") + front))
    order = ["shard", F.col("record_id").asc_nulls_first(), "payload_digest", "_order"]
    sent = rows.repartitionById(len(starts) + front, "shard").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = None
        kinds = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
        done: list[dict] = []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("shard", "record_id", "url", "payload_digest", "payload_bytes", "refers_to", "payload", "_order")), strict=True):
                shard, key, url, digest, own_size, own_refers, payload, payload_row = (x.as_py() for x in row)
                if not payload_row:
                    size, refers = own_size, own_refers
                    continue
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = Roller(folder, shard, roll_bytes)
                roller.add(record("response" if refers is None else "revisit", key, url, digest, size, refers, payload or b""))
        if roller is not None:
            roller.close()
            done += roller.done
        yield pa.RecordBatch.from_pylist(done, schema=kinds)

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{root}/{row['temporary']}", f"{root}/{row['name']}"
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    system.move(source, target)  # a repeated attempt of this task finds the file moved already
            yield batch

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{root}/{TEMPORARY}", recursive=True)
    attempts = f"{folder}/_attempts"
    sent.mapInArrow(write, MANIFEST).write.parquet(attempts)
    staged = spark.read.schema(MANIFEST).parquet(attempts)
    staged.repartition(min(len(starts) + front, 64), "name").mapInArrow(publish, MANIFEST).write.parquet(f"{folder}/_manifest")
    system.delete_dir(f"{root}/{TEMPORARY}")  # with files of attempts that were lost
    return f"{folder}/_manifest"


def records_of(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each gzip member of a stream, one record in memory at a time."""
    unpacker, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 16)
        rest = b""
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(unpacker.decompress(data))
        if unpacker.eof:
            rest, whole = unpacker.unused_data, b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
            head, _, block = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            size = int(headers["Content-Length"])
            if block[size:] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block[:size])}":
                raise ValueError(f"a damaged record: {headers['WARC-Record-ID']}")
            yield headers, block[:size]


def read_archives(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """(record_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of all records of a published folder."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for entry in batch.to_pylist():
                rows, held, seen = [], 0, 0
                with system.open_input_stream(f"{root}/{entry['name']}", compression=None) as stream:
                    for headers, block in records_of(stream):
                        kind, seen = headers["WARC-Type"], seen + 1
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and base32_sha1(payload) != digest:
                            raise ValueError(f"a payload that its digest doesn't fit: {headers['WARC-Record-ID']}")
                        key, refers = headers["X-Record-Key"], headers.get("X-Refers-To-Key")
                        size = int(headers["X-Payload-Length"]) if payload is None else len(payload)
                        shown = payload if with_payload else None
                        values = (int(key) if key else None, headers["WARC-Target-URI"], kind, size, digest, int(refers) if refers else None, shown)
                        rows.append(dict(zip(kinds.names, values, strict=True)))
                        held += len(shown or b"")
                        if held > 8 << 20 or len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                if seen != entry["records"]:
                    raise ValueError(f"{entry['name']} has {seen} records, the manifest {entry['records']}")
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    size = manifest.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first()
    readers = min(size["files"], MOST_READERS, -(-(size["bytes"] or 0) // READ_BYTES))
    return manifest.repartition(max(1, readers)).mapInArrow(read, RECORD)
