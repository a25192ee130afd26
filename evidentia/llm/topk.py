"""Exact top-k by inner product, with vectors in buckets of like length.

Components are made integers (``floor(scale * x)``).  Vectors are range-sorted by length, longest first, and packed into buckets.  A query
whose k-th score so far is ``t`` needs from a bucket of greatest length ``l`` only vectors at a cosine of ``t / (|q| l)`` or more: that is
its local threshold.  Above 1 the bucket is passed over.  Else the bucket is pruned in one of two ways, that which leaves fewer vectors:
by length (only vectors of length ``t / |q|`` or more, a front part of the bucket) or by coordinate (in each of the query's
``FOCUS`` largest coordinates, unit vectors at that cosine lie in an interval; the bucket's sorted coordinates give the vectors inside).
What is left is verified by exact integer products, so results do not depend on what was pruned.

First every query meets the longest bucket, whose size is bounded (``BUCKET_BYTES``), which gives it a first threshold.  Queries are then
range-sorted by the length they demand, ``t / |q|``, and packed into blocks; a block is sent to the shards that hold vectors of that
length, a shard's buckets come by from the longest, and the best k of each query and shard are merged.  A task holds a
block, its results and one bucket.  Blocks and shards are dealt by number, so a vector that is a third of all rows fills buckets like others.

Vectors that are null or hold null or non-finite components take no part.  Vectors of different dimensions are not compared; those without
components score 0.  Every row is a vector of its own, also where ids repeat; null ids are candidates that come last in
ties, and no queries.  Products are exact at any size of components; what a long cannot hold becomes its limit.  Queries with
fewer than k candidates return all.  An empty table gives no rows.  Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import store

BUCKET_BYTES = 2 << 20
BUCKET_ROWS = 4096
BLOCK_BYTES = 16 << 20
FOCUS = 4
#: Slack of pruning bounds, far above the error of their arithmetic; what it lets through is verified.
SLACK = 1e-9
LONG = 2**63 - 1
HUGE = np.finfo(np.float64).max
NO_ID = np.iinfo(np.int64).max

#: Types of components by their bytes.
WIDTHS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}
PACKED = "dim int, part int, number int, longest double, shortest double, rows int, keys binary, ids binary, named binary, lengths binary, matrix binary"
FOUND = "query_key bigint, query_id bigint, key bigint, vec_id bigint, score bigint"
PACK = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("number", pa.int32()), ("longest", pa.float64()), ("shortest", pa.float64()), ("rows", pa.int32())] + [(n, pa.binary()) for n in ("keys", "ids", "named", "lengths", "matrix")])
HITS = pa.schema([(n, pa.int64()) for n in ("query_key", "query_id", "key", "vec_id", "score")])


@dataclass
class Pack:
    """Rows of one dimension: keys, ids (``named``: not null), lengths, and integer components as doubles; they travel in as few bytes as hold them."""

    keys: np.ndarray
    ids: np.ndarray
    named: np.ndarray
    lengths: np.ndarray
    matrix: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Pack:
        def array(name: str, kind) -> np.ndarray:
            return np.frombuffer(row[name], kind)

        cells = row["rows"] * row["dim"]
        kind = WIDTHS[len(row["matrix"]) // cells] if cells else np.float64
        matrix = array("matrix", kind).reshape(row["rows"], row["dim"]).astype(np.float64)
        return cls(array("keys", np.int64), array("ids", np.int64), array("named", np.bool_), array("lengths", np.float64), matrix)

    def row(self, part: int, number: int) -> dict:
        data = {n: np.ascontiguousarray(getattr(self, n)).tobytes() for n in ("keys", "ids", "named", "lengths")}
        data["matrix"] = self.matrix.astype(self.narrowest()).tobytes()
        return data | {"dim": self.matrix.shape[1], "part": part, "number": number, "longest": float(self.lengths.max()), "shortest": float(self.lengths.min()), "rows": len(self.keys)}

    def narrowest(self) -> type:
        whole = np.isfinite(self.matrix).all() and (self.matrix == np.floor(self.matrix)).all()
        most = float(np.abs(self.matrix).max(initial=0.0)) if whole else np.inf
        return next(kind for _, kind in sorted(WIDTHS.items()) if kind is np.float64 or most <= np.iinfo(kind).max)

    @property
    def wide(self) -> bool:
        """Whether products may need more than the 53 bits of a double."""
        most = float(np.abs(self.matrix).max()) if self.matrix.size else 0.0
        return most * most * max(1, self.matrix.shape[1]) >= 2.0**52

    def units(self) -> np.ndarray:
        largest = np.abs(self.matrix).max(axis=1, keepdims=True, initial=0.0)
        scaled = np.divide(self.matrix, largest, out=np.zeros_like(self.matrix), where=largest > 0)
        size = np.sqrt((scaled**2).sum(axis=1, keepdims=True))
        return np.divide(scaled, size, out=np.zeros_like(scaled), where=size > 0)


def lengths_of(matrix: np.ndarray) -> np.ndarray:
    largest = np.abs(matrix).max(axis=1, keepdims=True, initial=0.0)
    scaled = np.divide(matrix, largest, out=np.zeros_like(matrix), where=largest > 0)
    return (np.sqrt((scaled**2).sum(axis=1, keepdims=True)) * largest)[:, 0]


def exact(vectors: np.ndarray, queries: np.ndarray, wide: bool) -> np.ndarray:
    """Integer inner products (queries, vectors); doubles hold them unless ``wide``, where Python's integers do."""
    if not wide:
        return (queries @ vectors.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in m.tolist()] for m in (queries, vectors))
    products = [[sum(a * b for a, b in zip(q, v, strict=True)) for v in right] for q in left]
    return np.array([[max(-LONG - 1, min(LONG, p)) for p in row] for row in products], np.int64).reshape(len(left), len(right))


class Bucket:
    """Vectors of like length, longest first, with what prunes them."""

    def __init__(self, pack: Pack):
        order = np.argsort(-pack.lengths, kind="stable")
        self.keys, self.ids, self.named, self.lengths, self.matrix = (x[order] for x in (pack.keys, pack.ids, pack.named, pack.lengths, pack.matrix))
        self.wide = pack.wide
        self.longest = float(self.lengths[0])
        self._sorted: tuple[np.ndarray, np.ndarray] | None = None

    def coordinates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit vectors, the order of each coordinate, its sorted values), made when first asked for."""
        if self._sorted is None:
            units = Pack(self.keys, self.ids, self.named, self.lengths, self.matrix).units()
            order = np.argsort(units, axis=0, kind="stable")
            self._sorted = units, order, np.take_along_axis(units, order, axis=0)
        return self._sorted


class Best:
    """The best k so far of each query of a block."""

    def __init__(self, queries: Pack, k: int):
        self.q, self.k, self.units = queries, k, queries.units()
        n = len(queries.keys)
        self.scores = np.zeros((n, k), np.int64)
        self.ids, self.keys = np.full((n, k), NO_ID), np.zeros((n, k), np.int64)
        self.named = np.zeros((n, k), np.bool_)
        self.count = np.zeros(n, np.int64)
        width = queries.matrix.shape[1]
        self.focus = np.argsort(-np.abs(self.units), axis=1, kind="stable")[:, : min(FOCUS, width)]

    def start(self, thresholds: np.ndarray) -> None:
        """Scores below those known already are never among the best."""
        self.floor = thresholds

    floor: np.ndarray | None = None

    def threshold(self) -> np.ndarray:
        """The score that a vector needs, as a double that is not above it; minus infinity while there are fewer than k."""
        found = np.where(self.count == self.k, self.scores[:, -1].astype(np.float64), -np.inf)
        if self.floor is not None:
            found = np.maximum(found, self.floor)
        return found - np.abs(np.where(np.isfinite(found), found, 0)) * SLACK

    def local(self, bucket: Bucket) -> np.ndarray:
        """Each query's cosine threshold in the bucket."""
        need, reach = self.threshold(), self.q.lengths * bucket.longest
        return np.where(need == -np.inf, -np.inf, np.divide(need, reach, out=np.where(need > 0, np.inf, -np.inf), where=reach > 0))

    def add(self, bucket: Bucket) -> None:
        cosine = self.local(bucket)
        asking = np.flatnonzero(cosine <= 1 + SLACK)
        if not len(asking):
            return
        by_length = self._by_length(bucket, asking)
        plans = {i: np.arange(n) for i, n in zip(asking.tolist(), by_length.tolist(), strict=True)}
        for i, at in self._by_coordinate(bucket, asking, cosine, by_length):
            if 2 * len(at) <= len(bucket.keys):
                plans[i] = at
        every = [i for i, at in plans.items() if 2 * len(at) > len(bucket.keys)]  # a front part each, computed together
        if every:
            most = max(len(plans[i]) for i in every)
            step = max(1, (4 << 20) // max(1, most))
            for low in range(0, len(every), step):
                rows = every[low : low + step]
                products = exact(bucket.matrix[:most], self.q.matrix[rows], bucket.wide or self.q.wide)
                for i, scores in zip(rows, products, strict=True):
                    self._merge(i, bucket, np.arange(most), scores)
        for i, at in plans.items():
            if 0 < len(at) and 2 * len(at) <= len(bucket.keys):
                self._merge(i, bucket, at, exact(bucket.matrix[at], self.q.matrix[i : i + 1], bucket.wide or self.q.wide)[0])

    def _by_length(self, bucket: Bucket, asking: np.ndarray) -> np.ndarray:
        """How many vectors, from the longest, are long enough for each query."""
        need, own = self.threshold()[asking], self.q.lengths[asking]
        length = np.where(need > 0, np.divide(need, own, out=np.full(len(own), np.inf), where=own > 0), -np.inf)
        return np.searchsorted(-bucket.lengths, -length * (1 - SLACK), side="right")

    def _by_coordinate(self, bucket: Bucket, asking: np.ndarray, cosine: np.ndarray, by_length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(query, vectors left) where coordinates leave fewer vectors than lengths do."""
        narrow = np.flatnonzero((cosine[asking] > 0) & (by_length > 0))
        if not len(narrow) or not self.focus.shape[1]:
            return
        units, order, values = bucket.coordinates()
        rows, most = asking[narrow], by_length[narrow]
        at = np.minimum(cosine[rows], 1.0)[:, None]
        own = np.take_along_axis(self.units[rows], self.focus[rows], axis=1)
        spread = np.sqrt(np.maximum((1 - at**2) * (1 - own**2), 0)) + 1e-7
        lows, highs = own * at - spread, np.minimum(own * at + spread, 2.0)
        highs = np.where(own >= at, 2.0, highs)  # the cap around the query holds the axis itself
        lows = np.where(-own >= at, -2.0, lows)
        first, last = np.zeros(own.shape, np.int64), np.zeros(own.shape, np.int64)
        for f in np.unique(self.focus[rows]).tolist():
            where = self.focus[rows] == f
            first[where] = np.searchsorted(values[:, f], lows[where], side="left")
            last[where] = np.searchsorted(values[:, f], highs[where], side="right")
        sizes = last - first
        best = sizes.argmin(axis=1)
        for j in np.flatnonzero(sizes.min(axis=1) < most).tolist():
            f, b = self.focus[rows[j]], best[j]
            left = order[first[j, b] : last[j, b], f[b]]
            inside = left < most[j]
            for c in range(len(f)):
                if c != b:
                    x = units[left, f[c]]
                    inside &= (x >= lows[j, c]) & (x <= highs[j, c])
            yield int(rows[j]), np.sort(left[inside])

    def _merge(self, i: int, bucket: Bucket, at: np.ndarray, scores: np.ndarray) -> None:
        fits = bucket.keys[at] != self.q.keys[i]
        if self.count[i] == self.k:
            fits &= scores >= self.scores[i, -1]
        if not fits.any():
            return
        at, scores, n = at[fits], scores[fits], self.count[i]
        new = [np.concatenate(x) for x in ((self.scores[i, :n], scores), (self.ids[i, :n], bucket.ids[at]), (self.named[i, :n], bucket.named[at]), (self.keys[i, :n], bucket.keys[at]))]
        order = np.lexsort((new[3], new[1], ~new[2], ~new[0]))[: self.k]  # ~score falls as the score grows
        size = self.count[i] = len(order)
        self.scores[i, :size], self.ids[i, :size], self.named[i, :size], self.keys[i, :size] = (x[order] for x in new)

    def hits(self) -> pa.RecordBatch:
        row, col = np.nonzero(np.arange(self.k) < self.count[:, None])
        ids = pa.array(self.ids[row, col], mask=~self.named[row, col])
        columns = [pa.array(self.q.keys[row]), pa.array(self.q.ids[row]), pa.array(self.keys[row, col]), ids, pa.array(self.scores[row, col])]
        return pa.RecordBatch.from_arrays(columns, schema=HITS)


def _integers(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(key, id, dim, length, vec) of the rows that take part; ``key`` names the row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, vectors = batch.num_rows, batch.column("vec")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = np.floor(np.float64(scale) * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
            flat = np.clip(flat, -HUGE, HUGE)
            lengths = np.zeros(rows)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size:
                    lengths[at] = lengths_of(flat[(ends[at] - size)[:, None] + np.arange(size)])
            keys = (np.int64(part) << 40) + number + np.arange(rows)
            number += rows
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("id"), pa.array(sizes.astype(np.int32)), pa.array(lengths), lists], names=["key", "id", "dim", "length", "vec"])

    numbers = F.col(vec_col).cast("array<double>")
    sound = F.col(vec_col).isNotNull() & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(sound).select(F.col(id_col).cast("bigint").alias("id"), numbers.alias("vec"))
    return rows.mapInArrow(measure, "key bigint, id bigint, dim int, length double, vec array<double>")


def _packs(rows: DataFrame, order: list, parts: int, most_bytes: int, most_rows: int) -> DataFrame:
    """Rows packed in an order within their dimension; ``part`` and ``number`` tell a pack's place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, held_rows = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            dim = table["dim"][0].as_py()
            ids = table["id"].combine_chunks()
            made = Pack(
                table["key"].to_numpy(), ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
                table["length"].to_numpy(), table["vec"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, dim),
            )
            return pa.RecordBatch.from_pylist([made.row(part, number)], PACK)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            at = 0
            while at < batch.num_rows:
                dim = int(dims[at])
                if held and (held[0].column("dim")[0].as_py() != dim or held_rows >= most(dim)):
                    yield packed()
                    number, held, held_rows = number + 1, [], 0
                same = int(np.argmax(dims[at:] != dim)) if (dims[at:] != dim).any() else batch.num_rows - at
                n = min(same, most(dim) - held_rows)
                held.append(batch.slice(at, n))
                held_rows, at = held_rows + n, at + n
        if held:
            yield packed()

    def most(dim: int) -> int:
        return max(1, min(most_rows, most_bytes // (8 * max(1, dim))))

    return rows.repartitionByRange(parts, "dim", *order).sortWithinPartitions("dim", *order).select("key", "id", "dim", "length", "vec").mapInArrow(pack, PACKED)


def _first_thresholds(packs: DataFrame, longest: DataFrame, parts: int, k: int) -> DataFrame:
    """(key, id, dim, length, vec, need) of each query: ``need`` is the score of its k-th vector in the longest bucket of its dimension, minus infinity if there is none.

    That bucket is sent once to each of ``parts`` groups of packs, and is all that a task holds beside the pack that comes by."""
    salt = F.pmod(F.xxhash64("part", "number"), F.lit(parts)).cast("int")
    both = longest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("side", F.lit(0))
    both = both.unionByName(packs.withColumn("salt", salt).withColumn("side", F.lit(1)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: Bucket | None = None
        for row in _rows(batches):
            pack = Pack.of(row)
            if row["side"] == 0:
                bucket = Bucket(pack)
                continue
            best = Best(pack, k)
            best.add(bucket)
            need = np.where(best.count == k, best.scores[:, -1].astype(np.float64), -np.inf)
            offsets = pa.array((np.arange(len(pack.keys) + 1) * row["dim"]).astype(np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(pack.matrix.ravel()))
            columns = [pa.array(pack.keys), pa.array(pack.ids), pa.array(np.full(len(pack.keys), row["dim"], np.int32)), pa.array(pack.lengths), vectors, pa.array(need)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "dim", "length", "vec", "need"])

    dealt = both.repartition("dim", "salt").sortWithinPartitions("dim", "salt", "side")
    return dealt.mapInArrow(meet, "key bigint, id bigint, dim int, length double, vec array<double>, need double")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def top_k(
    df: DataFrame, k: int, queries: str, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, bucket_rows: int = BUCKET_ROWS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets the SQL condition ``queries`` (over ``id``) its ``k`` best among all other rows."""
    spark = df.sparkSession
    store.bound_batches(spark)
    rows = store.table(_integers(df, id_col, vec_col, scale), "integer-vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = store.table(_packs(rows, [F.desc("length"), F.col("key")], parts, BUCKET_BYTES, bucket_rows), "length-buckets")
    asked = _packs(rows.filter(f"id IS NOT NULL AND ({queries})"), [F.col("key")], parts, BUCKET_BYTES, bucket_rows)
    first = Window.partitionBy("dim").orderBy("part", "number")
    heads = buckets.select("dim", "part", "number").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    longest = buckets.join(heads, ["dim", "part", "number"])
    needed = store.table(_first_thresholds(asked, longest, parts, k).withColumn("demand", F.col("need") / F.greatest("length", F.lit(1e-300))), "first-thresholds")
    demands = needed.withColumnRenamed("length", "own").select("key", "id", "dim", "own", F.col("demand").alias("length"), "vec", "need")
    return _ranked(_searched(demands, buckets, parts, k, bucket_rows, block_bytes), k)


def _searched(demands: DataFrame, buckets: DataFrame, parts: int, k: int, bucket_rows: int, block_bytes: int) -> DataFrame:
    """The best k of each query in each shard that it needs."""
    # a query travels as its components, then its own length and its first threshold
    carried = demands.withColumn("vec", F.concat("vec", F.array("own", "need"))).withColumn("dim", F.col("dim") + 2)
    blocks = store.table(_packs(carried, [F.desc("length"), F.col("key")], parts, block_bytes, max(1, block_bytes // 8)), "query-blocks")
    blocks = blocks.withColumn("dim", F.col("dim") - 2)
    shards = buckets.groupBy("dim", F.col("part").alias("shard")).agg(F.max("longest").alias("reach"))
    least = blocks.select("dim", F.col("part").alias("bp"), F.col("number").alias("bn"), F.col("shortest").alias("demand"))
    cells = least.join(shards, "dim").filter(F.col("reach") * (1 + 1e-6) >= F.col("demand")).select("dim", "bp", "bn", "shard")
    cells = store.table(cells, "search-cells")
    named = buckets.withColumnsRenamed({"part": "shard"})
    left = blocks.withColumnsRenamed({"part": "bp", "number": "bn"}).join(cells, ["dim", "bp", "bn"]).withColumn("number", F.lit(-1))
    right = named.join(cells, ["dim", "shard"])
    names = ["dim", "bp", "bn", "shard", "number", "longest", "rows", "keys", "ids", "named", "lengths", "matrix"]
    both = left.select(*names).union(right.select(*names)).repartition("dim", "bp", "bn", "shard").sortWithinPartitions("dim", "bp", "bn", "shard", "number")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        for row in _rows(batches):
            if row["number"] == -1:
                if best is not None:
                    yield best.hits()
                best = _block(row, k)
            elif best is not None:
                best.add(Bucket(Pack.of(row)))
        if best is not None:
            yield best.hits()

    return both.mapInArrow(search, FOUND)


def _block(row: dict, k: int) -> Best:
    pack = Pack.of(row | {"dim": row["dim"] + 2})
    best = Best(Pack(pack.keys, pack.ids, pack.named, pack.matrix[:, -2].copy(), np.ascontiguousarray(pack.matrix[:, :-2])), k)
    best.start(pack.matrix[:, -1].copy())
    return best


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "key")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
