"""MinHash near-duplicates: universal hash minima, banding, signature and full-set verification, connected components.

A document's set is that of its distinct shingles of five words (all words as one shingle where there are fewer) after
lower-casing A-Z.  Documents with 100 * intersection >= 75 * union are linked; a component is everything that links reach.

1. Every text is turned into its set size, a 128-bit id of the set, ``BANDS`` band keys of ``ROWS`` minima each and a sketch of
   one byte for each minimum.  Documents with equal sets are one class, represented by the smallest id.  At similarity 0.75 a
   pair shares no band with probability (1 - 0.75 ** 5) ** 50 = 1.3e-6.
2. In each bucket of a band, members are paired with the smallest and the largest id of the bucket only: links that hold
   join most of a group of near copies, with a number of pairs in proportion to the rows.
3. Components of these links are found by alternating large-star and small-star.
4. Buckets that still hold several components are worked through in blocks: the pairs across components whose sketches can
   stand for 0.75 (five standard deviations) are the candidates that could add a link.  A pair is only a candidate in the
   first band it shares by key: rows carry the keys of their earlier bands.  Members that have a candidate partner get their full sets; pairs are verified where they meet, and
   only links leave the task.  Members of a bucket are dealt in blocks of ``BLOCK`` rows or ``BLOCK_BYTES`` of sets, and each pair of
   blocks that can hold a pair across components is a group of its own; there is no cap on the members of a bucket.
5. The new links join components.

Nothing about all documents reaches the driver.  Rows without an id are returned unlinked and kept, as are null and empty texts
and documents without words, which have the empty set.  Very long texts are shingled whole.  Rows that share an id are one
document with the links of each of its texts; repeated rows are returned each.  An empty table gives no rows.  Extra columns of
the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import groups, store
from evidentia.llm.components import components

SHINGLE = 5
THRESHOLD = 75
BANDS, ROWS = 50, 5
#: Members of a block: by memory, 250 bytes of sketch and at most 400 of earlier keys each.
BLOCK = 4096
BLOCK_BYTES = 32 << 20
#: Share of equal sketch bytes below which a pair cannot have similarity 0.75: five standard deviations for 250 minima.
LEAST_EQUAL = 0.61
_RNG = np.random.default_rng(11)
_A = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64)
_WORD = _RNG.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = _RNG.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = "n int, set_id binary, bands array<bigint>, sketch binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Shingler:
    """Sets of texts, with the hashes of words that were met before; emptied at a number of words or of their bytes."""

    def __init__(self, table_size: int = 300_000, table_bytes: int = 16_000_000):
        self.known: dict[bytes, int] = {}
        self.size, self.bytes, self.held = table_size, table_bytes, 0

    def set_of(self, raw: bytes) -> np.ndarray:
        """The sorted 64-bit hashes of the distinct shingles of a text in UTF-8."""
        words = raw.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > self.size or self.held > self.bytes:
            self.known.clear()
            self.held = 0
        known = self.known
        for w in set(words).difference(known):
            known[w] = word_hash(w)
            self.held += len(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) < SHINGLE:
            return mixed(np.array([(h * _WORD[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
        n = len(h) - SHINGLE + 1
        total = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            total += h[i : i + n] * _WORD[i]
        return np.unique(mixed(total))


def minima(shingles: np.ndarray, block: int = 1024) -> np.ndarray:
    """The least a * x + b modulo 2 ** 64 of the set for each hash function."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), block):
        values = np.multiply.outer(shingles[at : at + block], _A)
        values += _B
        np.minimum(least, values.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    return mixed((rows * _ROW).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(_id, _salt, n, set_id, bands, sketch) for every row."""

    @F.arrow_udf(SIGNATURE)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler()
        for texts in batches:
            rows = []
            for value in texts.cast(pa.binary()):
                found = shingler.set_of(value.as_py() or b"")
                if not len(found):
                    rows.append((0, None, None, None))
                    continue
                least = minima(found)
                sketch = (mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()
                rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), band_keys(least), sketch))
            kinds = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["n", "set_id", "bands", "sketch"])

    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), sign(F.col(text_col)).alias("_s"))
    return rows.select("_id", groups.salt(F.col("_id")).alias("_salt"), "_s.*")


@F.arrow_udf(T.BinaryType())
def shingle_set(texts: pa.Array) -> pa.Array:
    shingler = Shingler()
    return pa.array([shingler.set_of(x.as_py() or b"").tobytes() for x in texts.cast(pa.binary())], pa.binary())


@F.arrow_udf(T.IntegerType())
def common(left: pa.Array, right: pa.Array) -> pa.Array:
    """Size of the intersection of two sorted sets."""
    pairs = zip(left, right, strict=True)
    return pa.array([overlap(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in pairs], pa.int32())


@F.arrow_udf(T.DoubleType())
def equal_share(left: pa.Array, right: pa.Array) -> pa.Array:
    """Share of equal bytes of two sketches."""
    shape = (-1, BANDS * ROWS)
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(shape) for x in (left, right))
    return pa.array((a == b).mean(axis=1))


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches can stand for a link."""
    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    rows = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb"))
    return rows.withColumn("_e", equal_share("sa", "sb")).filter(F.col("_e") >= LEAST_EQUAL).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").withColumn("i", common("x", "y").cast("bigint"))
    union = (F.octet_length("x") + F.octet_length("y")) / F.lit(8) - F.col("i")
    return rows.filter(100 * F.col("i") >= THRESHOLD * union).select("a", "b")


def dealt(members: DataFrame, scratch: store.Scratch, label: str) -> DataFrame:
    """The rows (key, rep, comp, n, ...) of each bucket in groups (key, i, j) that fit in a task and hold all pairs across components.

    The component with the most members of a bucket is its main one; within it no pair is of use.  Blocks of main members (``main``,
    i >= 0) meet blocks j of the others; the others meet among themselves (i = -1 - block) if they are of several components.
    A bucket that is all but resolved is thus dealt about once, however large its main component is."""
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    info = parts.groupBy("key").agg(
        F.max_by(F.struct("comp", "c", "s"), F.struct("c", "comp")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("comps")
    )
    blocks = lambda c, s: F.ceil(F.greatest(c / F.lit(BLOCK), s * F.lit(8 / BLOCK_BYTES))).cast("int")
    info = info.select("key", F.col("top.comp").alias("top"), blocks(F.col("top.c"), F.col("top.s")).alias("mains"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("others"), "comps")
    info = scratch.table(info.filter("comps > 1"), label)  # a plain join below, which adaptive execution can split where a key is hot
    rows = members.join(info, "key").withColumn("main", F.col("comp") == F.col("top"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    group = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    meets_main = F.transform(upto(F.col("mains")), lambda k: group(k, F.col("block")))
    meets_others = F.transform(upto(F.col("others")), lambda k: group(-1 - F.least(k, F.col("block")), F.greatest(k, F.col("block"))))
    places = F.when(F.col("main"), F.transform(upto(F.col("others")), lambda k: group(F.col("block"), k))).when(F.col("comps") > 2, F.concat(meets_main, meets_others)).otherwise(meets_main)
    rows = rows.withColumn("_g", F.explode(places)).withColumns({"i": F.col("_g.i"), "j": F.col("_g.j")}).drop("_g", "top", "mains", "others", "comps")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")


def across(members: DataFrame, sets: DataFrame, scratch: store.Scratch) -> DataFrame:
    """Links (a, b) across components, from the rows (key, band, rep, comp, n, sketch, earlier) of each bucket.

    Sketches first find the members that have a candidate partner at all; only those get their full sets, and are paired and
    verified where they meet.  What leaves a task are members and links, never candidate pairs."""
    involved = dealt(members, scratch, "dealt").mapInArrow(_members_with_partners, "key bigint, rep bigint").distinct()
    involved = scratch.table(involved, "involved")
    rows = scratch.table(members.join(involved, ["key", "rep"]), "paired").join(sets, "rep")
    return dealt(rows, scratch, "dealt-sets").mapInArrow(_links, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (key, i, j), from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = _starts(pa.Table.from_batches([batch]))
        if not len(starts):
            continue
        continued = held and all(batch.column(c)[0].as_py() == held[-1].column(c)[-1].as_py() for c in ("key", "i", "j"))
        if held and not continued:
            yield pa.Table.from_batches(held)
            held = []
        if len(starts) > 1:
            yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            held = []
        held.append(batch.slice(starts[-1]))
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table) -> np.ndarray:
    keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("key", "i", "j")])
    return np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if table.num_rows else np.empty(0, int)


def _candidates(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of the candidate pairs in the groups of a table, a part at a time."""
    starts = np.append(_starts(table), table.num_rows)
    comp, n, band, block, main, i, j = (table[c].to_numpy() for c in ("comp", "n", "band", "block", "main", "i", "j"))
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    held = np.arange(BANDS) < band[:, None]
    earlier = np.zeros(held.shape, np.int64)
    earlier[held] = table["earlier"].combine_chunks().flatten().to_numpy()

    def plausible_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= THRESHOLD * np.maximum(n[a], n[b]))
        a, b = a[keep], b[keep]
        keep = (sketch[a] == sketch[b]).mean(axis=1) >= LEAST_EQUAL
        a, b = a[keep], b[keep]
        first = ~((earlier[a] == earlier[b]) & held[a]).any(axis=1)
        return a[first], b[first]

    sizes = np.diff(starts)
    twos = starts[:-1][sizes == 2]
    for at in range(0, len(twos), 20_000):
        yield plausible_pairs(twos[at : at + 20_000], twos[at : at + 20_000] + 1)
    for start, size in zip(starts[:-1], sizes, strict=True):
        if size <= 2:
            continue
        rows = np.arange(start, start + size)
        if i[start] >= 0:
            left, right = rows[main[rows]], rows[~main[rows]]
        else:
            left, right = rows[block[rows] == -1 - i[start]], rows[block[rows] == j[start]]
        step = max(1, 40_000 // max(len(right), 1))
        for at in range(0, len(left), step):
            a, b = (x.ravel() for x in np.meshgrid(left[at : at + step], right, indexing="ij"))
            if -1 - i[start] == j[start]:
                a, b = a[a < b], b[a < b]
            yield plausible_pairs(a, b)


def _members_with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches):
        used = np.zeros(table.num_rows, bool)
        for a, b in _candidates(table):
            used[a] = used[b] = True
        rows = table.select(["key", "rep"]).filter(pa.array(used)).combine_chunks()
        yield from rows.to_batches()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches):
        rep, found = table["rep"].to_numpy(), set()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].combine_chunks()]
        for a, b in _candidates(table):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                if linked(sets[x], sets[y]):
                    found.add((min(rep[x], rep[y]), max(rep[x], rep[y])))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = overlap(a, b)
    return 100 * shared >= THRESHOLD * (len(a) + len(b) - shared)


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``.

    Sides that are aggregated by band key are written before they are joined: a join of two plain shuffles is one that adaptive
    execution can split at a hot key."""
    store.bound_batches(df.sparkSession)
    scratch = store.Scratch(df.sparkSession)
    rows = store.table(signatures(df, text_col, id_col), "signatures")
    sets = rows.filter("n > 0 and _id is not null")
    best = sets.groupBy("set_id").agg(F.min_by(F.struct("n", "bands", "sketch"), "_id").alias("s"), F.min("_id").alias("rep"))
    classes = scratch.table(best.select("rep", "set_id", "s.*"), "classes")

    keyed = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    heads = scratch.table(keyed.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).filter("head != tail"), "heads")
    members = scratch.table(keyed.join(heads, "key"), "members")

    stars = members.select(F.col("head").alias("a"), F.col("rep").alias("b")).unionByName(members.select(F.col("rep").alias("a"), F.col("tail").alias("b")))
    stars = scratch.table(plausible(stars.filter("a != b").distinct(), classes), "stars")
    wanted = members.select("rep").distinct()
    texts = df.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).alias("_t")).join(wanted, "rep", "left_semi")
    full = scratch.table(texts.select("rep", shingle_set("_t").alias("shingles")).dropDuplicates(["rep", "shingles"]), "sets")
    full = full.filter(F.octet_length("shingles") > 0)  # on the written table: above, it would run before the join, over all texts
    links = scratch.table(verified(stars, full), "links")

    first = scratch.table(components(links), "first")
    placed = members.select("key", "band", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left")
    placed = scratch.table(placed.select("key", "band", "rep", F.coalesce("label", "rep").alias("comp")), "placed")
    mixed_keys = scratch.table(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key"), "mixed")
    unresolved = placed.join(mixed_keys, "key").join(classes.select("rep", "n", "sketch", "bands"), "rep")
    unresolved = scratch.table(unresolved.withColumn("earlier", F.slice("bands", F.lit(1), F.col("band"))).drop("bands"), "unresolved")
    more = scratch.table(across(unresolved, full, scratch).distinct(), "more")

    known = first.select("node", "label")

    def label_of(side: str) -> DataFrame:
        return known.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))

    joined = more.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    second = components(joined).select(F.col("node").alias("label"), F.col("label").alias("root"))
    roots = classes.select("rep", "set_id").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    roots = roots.withColumn("label", F.coalesce("label", "rep")).join(second, "label", "left")
    roots = store.table(roots.select("set_id", F.coalesce("root", "label").alias("component_id")), "roots")
    scratch.drop(*list(scratch.paths))

    salts = sets.select("set_id", "_salt").distinct().join(roots, "set_id")
    linked = rows.join(salts, ["set_id", "_salt"], "left")
    component = F.coalesce(F.when(F.col("_id").isNotNull(), F.col("component_id")), F.col("_id"))
    out = linked.select("_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
