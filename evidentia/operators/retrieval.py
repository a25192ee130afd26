"""Evidence retrieval: feature-hash vectors, lexical overlap, cosine and the hybrid ranking.

A set of queries is ranked against all evidence without a cross join of rows.  Each task scores its evidence against a block
of queries and only passes on its best ``k`` for each query, in the final order; a window then picks the best of the tasks'
candidates.  What is shuffled is k rows for each query and task, however large the evidence is.  Queries of a checked size
travel to the tasks.  Beyond it evidence is dealt into blocks, once, and held by a task while all queries stream past it: evidence is
never copied, queries are sent once for each block of evidence.  For lexical ranking a held block is an inverted index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import scores, text

DIMENSIONS = 256
#: Queries and their tokens that travel to every task at most; beyond, they are dealt into blocks of so many.
QUERY_BLOCK, QUERY_TOKENS = 1024, 500_000
#: Evidence rows and tokens of a block, about, that a task holds while queries stream by.
EVIDENCE_BLOCK, EVIDENCE_TOKENS = 50_000, 10_000_000
#: Width of the ranges of ids that one task numbers.
ID_RANGE = 100_000
#: Bytes of a table, about, that may be dealt anew to use all cores.
SPREAD_BYTES = 1 << 30
#: Vectors or queries of a block, about, and pairs scored at once.
VECTOR_BLOCK, VECTOR_NUMBERS = 8192, 8_000_000
PAIRS = 1 << 20
#: Tokens of evidence that are scored at once, about, and bytes of a batch of it.
TOKENS, BATCH_BYTES = 250_000, 8 << 20
#: Tokens whose hashes a task remembers.
FEATURES = 500_000
CANDIDATES = "query_id bigint, evidence_id bigint, score double, lexical double, vector double, shared bigint"


def hashed(features: Iterable[bytes]) -> np.ndarray:
    """The first four bytes of the hash of each feature, and behind them the lowest bit of the fifth."""
    digests = np.frombuffer(b"".join([hashlib.sha256(x).digest() for x in features]), np.uint8).reshape(-1, 32)
    return np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64) * 2 + (digests[:, 4] & 1)


class Features:
    """Signed buckets of features; hashes of tokens are remembered, those of bigrams, which seldom come again, are not."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > FEATURES:
            known.clear()
        new = [t for t in tokens if t not in known]
        known.update(zip(new, hashed([t.encode() for t in new]).tolist(), strict=True))
        return np.array([known[t] for t in tokens], np.int64)

    def vectors(self, tokens: TokenLists, dimensions: int = DIMENSIONS) -> np.ndarray:
        """The signed counts of tokens and bigrams of each list, a row for each; distinct ones are hashed once."""
        n, doc = len(tokens.names), tokens.doc
        own = self.hashes(tokens.names)[tokens.codes]
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        pairs, where = np.unique(tokens.codes[inner] * max(n, 1) + tokens.codes[inner + 1], return_inverse=True)
        first, second = [name.encode() for name in tokens.names], [b"_" + name.encode() for name in tokens.names]
        # some features at a time, as a long list may have any number
        parts = [pairs[at : at + TOKENS] for at in range(0, len(pairs), TOKENS)]
        joined = [hashed([first[a] + second[b] for a, b in zip((p // n).tolist(), (p % n).tolist(), strict=True)]) for p in parts]
        both = np.concatenate([own, np.concatenate(joined)[where] if joined else np.empty(0, np.int64)])
        cell = np.concatenate([doc, doc[inner]]) * dimensions + both // 2 % dimensions
        return np.bincount(cell, 1.0 - 2.0 * (both % 2), tokens.rows * dimensions).reshape(tokens.rows, dimensions)


class TokenLists:
    """Token lists as numbers of distinct tokens; null lists are empty."""

    def __init__(self, lists: pa.Array):
        lists = pa.array(lists.to_pylist(), pa.list_(pa.string())).fill_null([]) if lists.null_count else lists
        coded = lists.flatten().dictionary_encode()
        self.rows, self.names = len(lists), coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def feature_counts(tokens: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of the token and bigram hashes of one list."""
    return Features().vectors(TokenLists(pa.array([tokens], pa.list_(pa.string()))), dimensions)[0].astype(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def feature_hash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The integer feature-hash vector of each token list; dividing by its length gives the unit vector."""
    features = Features()
    for tokens in batches:
        flat = [features.vectors(TokenLists(tokens[at:end])).astype(np.int64).ravel() for at, end in cuts(tokens, 2000)]
        yield pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)), DIMENSIONS).cast(pa.list_(pa.int64()))


class QueryBlock:
    """Queries as a matrix of vectors and an inverted index from tokens to queries."""

    def __init__(self, ids: list, lists: pa.Array, features: Features):
        tokens = TokenLists(lists)
        self.ids, self.features = np.array(ids, np.int64), features
        n = max(len(tokens.names), 1)
        pairs = np.unique(tokens.codes * max(tokens.rows, 1) + tokens.doc)  # by token, then query
        of, self.queries = pairs // max(tokens.rows, 1), pairs % max(tokens.rows, 1)
        self.counts = np.bincount(of, minlength=n)
        self.starts = np.cumsum(self.counts) - self.counts
        self.index = {name: i for i, name in enumerate(tokens.names)}
        self.sizes = np.maximum(np.bincount(self.queries, minlength=tokens.rows), 1)
        self.vectors = features.vectors(tokens)
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))

    def shared(self, tokens: TokenLists) -> np.ndarray:
        """Tokens that each list shares with each query."""
        known = np.array([self.index.get(name, -1) for name in tokens.names], np.int64)
        own = known[tokens.codes] if len(known) else np.empty(0, np.int64)
        pairs = np.unique(tokens.doc[own >= 0] * max(len(self.index), 1) + own[own >= 0])
        doc, token = pairs // max(len(self.index), 1), pairs % max(len(self.index), 1)
        counts = self.counts[token]
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[token] - (ends - counts), counts)
        return np.bincount(np.repeat(doc, counts) * len(self.ids) + self.queries[at], minlength=tokens.rows * len(self.ids)).reshape(tokens.rows, len(self.ids))

    def cosine(self, tokens: TokenLists) -> np.ndarray:
        """Cosine of each list with each query, clamped at 0."""
        vectors = self.features.vectors(tokens)
        dots, lengths = vectors @ self.vectors.T, self.norms[None, :] * np.sqrt((vectors**2).sum(axis=1))[:, None]
        return np.maximum(np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0), 0.0)


class Best:
    """The best ``k`` evidence rows of each query so far, in the final order."""

    def __init__(self, block: QueryBlock, k: int, weights: tuple[float, float] | None):
        self.block, self.k, self.weights, self.held = block, k, weights, None

    def add(self, ids: np.ndarray, lists: pa.Array) -> None:
        for at, end in cuts(lists, max(1, PAIRS // max(len(self.block.ids), 1))):
            self._add(ids[at:end], lists[at:end])

    def _add(self, ids: np.ndarray, lists: pa.Array) -> None:
        tokens = TokenLists(lists)
        self.take(ids, lists, tokens, self.block.shared(tokens))

    def take(self, ids: np.ndarray, lists: pa.Array, tokens: TokenLists, shared: np.ndarray) -> None:
        lexical = shared / self.block.sizes
        if self.weights is None:
            vector, score = np.zeros(shared.shape), np.where(shared > 0, np.floor(lexical * 10_000 + 0.5), -1.0)
        else:
            vector = np.zeros(shared.shape)
            if self.weights[1]:
                near = self.near(lexical)
                if not near.all():
                    ids, shared, lexical, vector = ids[near], shared[near], lexical[near], vector[near]
                    tokens = TokenLists(lists.filter(pa.array(near)))
                if not len(ids):
                    return
                vector = self.block.cosine(tokens)
            score = np.minimum(1.0, lexical * self.weights[0] + vector * self.weights[1])
        found = (score, lexical, vector, shared, np.broadcast_to(ids[:, None], score.shape))
        found = found if self.held is None else tuple(np.concatenate(x) for x in zip(self.held, found, strict=True))
        order = np.lexsort((found[4], -np.floor(found[1] * 10_000 + 0.5), -found[0]), axis=0)[: self.k]
        self.held = tuple(np.take_along_axis(x, order, axis=0) for x in found)

    def near(self, lexical: np.ndarray) -> np.ndarray:
        """Rows that a cosine of 1 would bring among the best of any query so far: no other needs its vector."""
        if self.held is None or len(self.held[0]) < self.k or self.weights[1] < 0:
            return np.ones(len(lexical), np.bool_)
        most = np.minimum(1.0, lexical * self.weights[0] + (1 + 1e-9) * self.weights[1])
        return (most >= self.held[0][-1]).any(axis=1)

    def rows(self) -> pa.Table:
        score, lexical, vector, shared, ids = self.held if self.held is not None else [np.empty((0, len(self.block.ids)))] * 5
        queries = np.broadcast_to(self.block.ids[None, :], score.shape)
        columns = [(queries, pa.int64()), (ids, pa.int64()), (score, pa.float64()), (lexical, pa.float64()), (vector, pa.float64()), (shared, pa.int64())]
        return pa.table([pa.array(x.ravel().astype(t.to_pandas_dtype()), t) for x, t in columns], names=[c.split()[0] for c in CANDIDATES.split(", ")])


class BestOfModes(Best):
    """The best ``k`` of each query under each of several weights; tokens are cut and compared once."""

    def __init__(self, block: QueryBlock, k: int, modes: list[tuple[float, float]]):
        super().__init__(block, k, None)
        self.modes = [Best(block, k, weights) for weights in modes]

    def take(self, ids: np.ndarray, lists: pa.Array, tokens: TokenLists, shared: np.ndarray) -> None:
        for best in self.modes:
            best.take(ids, lists, tokens, shared)

    def rows(self) -> pa.Table:
        found = [best.rows() for best in self.modes]
        return pa.concat_tables([t.append_column("mode", pa.array(np.full(t.num_rows, i, np.int32))) for i, t in enumerate(found)])


def candidates(evidence: DataFrame, queries: DataFrame, k: int, weights: tuple[float, float] | list[tuple[float, float]] | None) -> DataFrame:
    """The best ``k`` rows of each query in each task or cell, as ``CANDIDATES``; without weights by shared tokens alone.

    With a list of weights, the best under each of them, with their place as ``mode`` behind the other columns."""
    schema = f"{CANDIDATES}, mode int" if isinstance(weights, list) else CANDIDATES
    _bound_batches(evidence)
    evidence = spread(evidence.select(F.col("evidence_id").cast("bigint"), "tokens"))
    queries = queries.select(F.col("query_id").cast("bigint"), "tokens")
    size = queries.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
    if size["rows"] <= QUERY_BLOCK and size["tokens"] <= QUERY_TOKENS:
        asked = queries.toArrow()

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _best(asked, k, weights)
            for batch in batches:
                best.add(batch.column("evidence_id").to_numpy(zero_copy_only=False), batch.column("tokens"))
            yield from best.rows().to_batches()

        return evidence.mapInArrow(local, schema)
    held = evidence.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
    across = max(-(-size["rows"] // QUERY_BLOCK), -(-size["tokens"] // QUERY_TOKENS))
    down = max(1, -(-held["rows"] // EVIDENCE_BLOCK), -(-held["tokens"] // EVIDENCE_TOKENS))

    def scored(evidence: pa.Table, blocks: Iterator[pa.Table]) -> Iterator[pa.Table]:
        ids, lists = evidence["id"].to_numpy(), _one(evidence["value"])
        index = EvidenceIndex(ids, lists) if weights is None else None
        for asked in blocks:
            if index is not None:
                yield index.candidates(asked["id"].to_pylist(), _one(asked["value"]), k)
            else:
                best = _of(QueryBlock(asked["id"].to_pylist(), _one(asked["value"]), Features()), k, weights)
                best.add(ids, lists)
                yield best.rows()

    left = queries.select(F.col("query_id").alias("id"), F.col("tokens").alias("value"))
    right = evidence.select(F.col("evidence_id").alias("id"), F.col("tokens").alias("value"))
    return _past_blocks(right, down, left, across, scored, schema)


def _past_blocks(held: DataFrame, blocks: int, passing: DataFrame, parts: int, score, schema: str) -> DataFrame:
    """``score(block, parts)`` for each of the ``blocks`` of the rows (id, value) held, with all rows passing, in ``parts`` parts, one after another.

    Rows held are moved once; those passing are sent once for each block."""
    right = held.select(F.pmod(F.xxhash64("id", "value"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("part"), "id", "value")
    left = passing.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "value")
    dealt = right.union(left).repartition("block").sortWithinPartitions("block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, None
        for (at, part), table in _runs(batches):
            if part == -1:
                block, rows = at, table
            elif at == block:
                for found in score(rows, iter([table])):
                    yield from found.to_batches()

    return dealt.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """((block, part), its rows) of rows sorted by both."""
    key, held = None, []
    for batch in batches:
        both = np.stack([batch.column("block").to_numpy(), batch.column("part").to_numpy()])
        edges = [0, *(np.flatnonzero((both[:, 1:] != both[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:], strict=False):
            if begin < end:
                new = int(both[0, begin]), int(both[1, begin])
                if new != key and held:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = new
                held.append(batch.slice(begin, end - begin))
    if held:
        yield key, pa.Table.from_batches(held)


def _past_scopes(held: DataFrame, passing: DataFrame, scope: list[str], rows: int, score, schema: str) -> DataFrame:
    """``score(block, part)`` where rows (scope, id, value) of one scope meet: those held in blocks of about ``rows``, those passing in parts.

    A scope is the values of some columns; nulls belong to none.  A scope with a third of all rows is many blocks, each a group of
    its own.  The result has the scope's columns before those of ``schema``."""
    sizes = held.groupBy(*scope).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts"))
    right = held.join(sizes, scope).select(*scope, F.pmod(F.xxhash64("id", "value"), F.col("_parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "value")
    left = passing.join(sizes, scope).select(*scope, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "value")
    dealt = right.union(left).repartition(*scope, "part").sortWithinPartitions(*scope, "part", "side")
    keys = [*scope, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, None
        for key, side, table in _scoped_runs(batches, keys):
            if side == 0:
                block, own = table, key
            elif key == own:
                found = score(block, table)
                columns = [pa.array([v] * found.num_rows, table.schema.field(n).type) for n, v in zip(scope, key, strict=False)]
                yield from pa.table([*columns, *found.columns], names=[*scope, *found.column_names]).to_batches()

    kinds = ", ".join(f"{n} {held.schema[n].dataType.simpleString()}" for n in scope)
    return dealt.mapInArrow(run, f"{kinds}, {schema}")


def _scoped_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, int, pa.Table]]:
    """(key, side, its rows) of rows sorted by key and side; rows of side 1 come in parts of at most ``QUERY_BLOCK``."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(n) for n in (*keys, "side")]
        new = np.zeros(batch.num_rows, np.bool_)
        for c in columns:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:], strict=False):
            for at in range(begin, end, QUERY_BLOCK):
                *key, side = (c[at].as_py() for c in columns)
                if held and ((tuple(key), side) != now or (side == 1 and sum(b.num_rows for b in held) >= QUERY_BLOCK)):
                    yield *now, pa.Table.from_batches(held)
                    held = []
                now = tuple(key), side
                held.append(batch.slice(at, min(QUERY_BLOCK, end - at)))
    if held:
        yield *now, pa.Table.from_batches(held)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


class EvidenceIndex:
    """Postings of the distinct tokens of a block of evidence, rows by id."""

    def __init__(self, ids: np.ndarray, lists: pa.Array):
        order = np.argsort(ids, kind="stable")
        self.ids, tokens = ids[order], TokenLists(lists.take(pa.array(order)))
        rows = max(tokens.rows, 1)
        pairs = np.unique(tokens.codes * rows + tokens.doc)
        of, self.rows = pairs // rows, pairs % rows
        self.counts = np.bincount(of, minlength=len(tokens.names))
        self.starts = np.cumsum(self.counts) - self.counts
        self.index = {name: i for i, name in enumerate(tokens.names)}

    def best(self, tokens: list[str], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, shared tokens, distinct tokens asked for) of the best ``k`` rows for a query.

        Tokens are taken from the rarest.  A row met first at a token lacks all rarer ones, which bounds what it can share; once the bound of
        the next token falls below the k-th row found, no other row can be among the best, and common tokens are never listed."""
        asked = set(tokens)
        known = sorted((i for i in map(self.index.get, asked) if i is not None), key=lambda i: (self.counts[i], i))
        postings = [self.rows[self.starts[i] : self.starts[i] + self.counts[i]] for i in known]
        size, found, shared, seen = max(len(asked), 1), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

        def key(n):
            return np.floor(n / size * 10_000 + 0.5)

        for at, rows in enumerate(postings):
            if len(found) >= k and key(shared[-1]) > key(len(postings) - at):
                break
            new = np.setdiff1d(rows, seen, assume_unique=True)
            seen = np.union1d(seen, new)
            count = np.ones(len(new), np.int64)
            for later in postings[at + 1 :]:
                place = np.minimum(np.searchsorted(later, new), len(later) - 1)
                count += later[place] == new
            found, shared = np.concatenate([found, new]), np.concatenate([shared, count])
            order = np.lexsort((found, -key(shared)))[:k]  # rows stand by id
            found, shared = found[order], shared[order]
        return found, shared, size

    def candidates(self, queries: list, lists: pa.Array, k: int) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for query, tokens in zip(queries, lists.to_pylist(), strict=True):
            rows, shared, size = self.best(tokens or [], k)
            for column, values in zip(out, ([query] * len(rows), self.ids[rows], np.floor(shared / size * 10_000 + 0.5), shared / size, shared), strict=True):
                column.extend(values)
        columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()), pa.array(np.zeros(len(out[0]))), pa.array(out[4], pa.int64())]
        return pa.table(columns, names=[c.split()[0] for c in CANDIDATES.split(", ")])


def cuts(lists: pa.Array, rows: int) -> list[tuple[int, int]]:
    """Ranges of at most ``rows`` lists and about ``TOKENS`` tokens."""
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    out, at = [], 0
    while at < len(lists):
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + TOKENS, side="right"))))
        out.append((at, end))
        at = end
    return out


def _bound_batches(df: DataFrame) -> None:
    """Limit the Arrow batches of the session to ``BATCH_BYTES``, so that long texts don't fill a Python worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(name).removesuffix("b")) > BATCH_BYTES:
        df.sparkSession.conf.set(name, f"{BATCH_BYTES}b")


def _of(block: QueryBlock, k: int, weights: tuple[float, float] | list[tuple[float, float]] | None) -> Best:
    return BestOfModes(block, k, weights) if isinstance(weights, list) else Best(block, k, weights)


def _best(asked: pa.Table, k: int, weights: tuple[float, float] | list[tuple[float, float]] | None) -> Best:
    lists = asked["tokens"].combine_chunks()
    return _of(QueryBlock(asked["query_id"].to_pylist(), lists, Features()), k, weights)


def spread(df: DataFrame, split: bool = True) -> DataFrame:
    """The rows over all cores where a scan has fewer parts than there are cores: a small table in one row group is one task.

    Only tables that are small by the plan's estimate (``SPREAD_BYTES``) are moved; others are left as they are, whatever the cores.
    A file of one row group is planned as several parts, of which one has all the rows: without ``split`` parts are not counted, for
    narrow tables with much work a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SPREAD_BYTES
    return df.repartition(cores) if small and (not split or df.rdd.getNumPartitions() < cores) else df


def _scoped_candidates(evidence: DataFrame, queries: DataFrame, scope: list[str], k: int, weights: tuple[float, float]) -> DataFrame:
    def scored(block: pa.Table, asked: pa.Table) -> pa.Table:
        best = Best(QueryBlock(asked["id"].to_pylist(), _one(asked["value"]), Features()), k, weights)
        best.add(block["id"].to_numpy(), _one(block["value"]))
        return best.rows()

    held = evidence.select(*scope, F.col("evidence_id").cast("bigint").alias("id"), F.col("tokens").alias("value"))
    passing = queries.select(*scope, F.col("query_id").cast("bigint").alias("id"), F.col("tokens").alias("value"))
    return _past_scopes(held, passing, scope, EVIDENCE_BLOCK, scored, CANDIDATES)


def rank(
    evidence: DataFrame, queries: DataFrame, k: int, vector_weight: float = scores.VECTOR_WEIGHT, lexical_weight: float = scores.LEXICAL_WEIGHT, scope: list[str] | None = None
) -> DataFrame:
    """(scope, query_id, evidence_id, rank, lexical_score, vector_score, retrieval_score) of the best ``k`` of each query.

    With ``scope``, names of columns that both sides have (owner, model, ...), a query is ranked against the evidence of its own scope alone.

    ``evidence`` has (evidence_id, tokens), ``queries`` (query_id, tokens); both ids are bigint.  Ordered by the unrounded score, then the rounded lexical score, then the id;
    reported scores have four decimals."""
    within, weights = scope or [], (lexical_weight, vector_weight)
    return _ranked(_scoped_candidates(evidence, queries, within, k, weights) if within else candidates(evidence, queries, k, weights), within, k)


def rank_modes(evidence: DataFrame, queries: DataFrame, k: int, modes: dict[str, tuple[float, float]]) -> DataFrame:
    """(mode, query_id, evidence_id, ...) as by ``rank``, under each of some named (lexical weight, vector weight); evidence is read once for all."""
    best = candidates(evidence, queries, k, list(modes.values()))
    return _ranked(best.withColumn("mode", F.element_at(F.array(*map(F.lit, modes)), F.col("mode") + 1)), ["mode"], k)


def _ranked(best: DataFrame, within: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*within, "query_id").orderBy(F.desc("score"), F.desc("lexical_score"), "evidence_id")
    ranked = best.withColumn("lexical_score", scores.unit_score(F.col("lexical"))).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= k).select(
        *within, "query_id", "evidence_id", "rank", "lexical_score", scores.unit_score(F.col("vector")).alias("vector_score"), scores.unit_score(F.col("score")).alias("retrieval_score")
    )


def full_order(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, evidence_id, rank, shared, lexical_score) of all evidence for each query of a stated set, by shared tokens.

    Scored rows stream out of the tasks as they are made; none is held.  Places are numbered in two levels: each query's rows are counted
    by their number of shared tokens, which gives every such group its first place; within a group ids are cut into ranges whose
    sizes are summed, so that no task sorts all rows of a query."""
    size = queries.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
    asked = queries.select(F.col("query_id").cast("bigint").alias("id"), F.col("tokens").alias("value"))
    rows = spread(evidence.select(F.col("evidence_id").cast("bigint"), "tokens"))

    def pairs(ids: np.ndarray, lists: pa.Array, block: QueryBlock) -> Iterator[pa.RecordBatch]:
        for at, end in cuts(lists, max(1, PAIRS // max(len(block.ids), 1))):
            shared = block.shared(TokenLists(lists[at:end]))
            own, queries_of = np.repeat(ids[at:end], shared.shape[1]), np.tile(block.ids, len(shared))
            lexical = (shared / block.sizes).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(queries_of), pa.array(own), pa.array(lexical), pa.array(shared.ravel().astype(np.int64))], names=["query_id", "evidence_id", "lexical", "shared"])

    schema = "query_id bigint, evidence_id bigint, lexical double, shared bigint"
    if size["rows"] <= QUERY_BLOCK and size["tokens"] <= QUERY_TOKENS:
        held = asked.toArrow()

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = QueryBlock(held["id"].to_pylist(), held["value"].combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.string())), Features())
            for batch in batches:
                if len(block.ids):
                    yield from pairs(batch.column("evidence_id").to_numpy(zero_copy_only=False), batch.column("tokens"), block)

        scored = rows.mapInArrow(local, schema)
    else:
        down = max(1, -(-evidence.count() // EVIDENCE_BLOCK))

        def passing(block: pa.Table, parts: Iterator[pa.Table]) -> Iterator[pa.Table]:
            for part in parts:
                of = QueryBlock(part["id"].to_pylist(), _one(part["value"]), Features())
                for batch in pairs(block["id"].to_numpy(), _one(block["value"]), of):
                    yield pa.Table.from_batches([batch])

        scored = _past_blocks(rows.select(F.col("evidence_id").alias("id"), F.col("tokens").alias("value")), down, asked, max(1, -(-size["rows"] // QUERY_BLOCK), -(-size["tokens"] // QUERY_TOKENS)), passing, schema)
    # ids in ranges of a fixed width: sorted by range, then by id within one
    ranged = scored.withColumn("range", F.floor(F.col("evidence_id") / ID_RANGE))
    groups = ranged.groupBy("query_id", "shared", "range").agg(F.count("*").alias("n"))
    along = Window.partitionBy("query_id").orderBy(F.desc("shared"), "range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    own = Window.partitionBy("query_id", "shared", "range").orderBy("evidence_id")
    placed = ranged.withColumn("_n", F.row_number().over(own)).join(firsts, ["query_id", "shared", "range"])
    return placed.select("query_id", "evidence_id", (F.col("before") + F.col("_n")).cast("bigint").alias("rank"), "shared", scores.unit_score(F.col("lexical")).alias("lexical_score"))


def lexical_topk(evidence: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, evidence_id, rank, shared, lexical_score): the best ``k`` by shared tokens alone, of those that share any."""
    best = candidates(evidence, queries, k, None).filter("shared > 0").withColumn("lexical_score", scores.unit_score(F.col("lexical")))
    order = Window.partitionBy("query_id").orderBy(F.desc("lexical_score"), "evidence_id")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "evidence_id", "rank", "shared", "lexical_score")


def cosine(left, right):
    """Cosine of two double arrays, 0 where either has no length; arrays of unequal lengths are an error."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    value = F.coalesce(F.try_divide(dot, norm(left) * norm(right)), F.lit(0.0))
    return F.when(F.size(left) == F.size(right), value).otherwise(F.raise_error(F.lit("vectors must have the same dimensions")).cast("double"))


def vector_fault(vector, dimensions=None):
    """What is wrong with a vector (array of doubles): nothing in it, a value that is null or not finite, or another length; else null."""
    strange = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = F.when(F.coalesce(F.size(vector), F.lit(0)) <= 0, "empty").when(strange, "not finite")
    return fault if dimensions is None else fault.when(F.size(vector) != dimensions, "dimensions")


def valid_vector(vector, dimensions=None):
    """The vector, or an error that names its fault."""
    fault = vector_fault(vector, dimensions)
    return F.when(fault.isNull(), vector).otherwise(F.raise_error(F.concat(F.lit("bad vector: "), fault)).cast("array<double>"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, scope: list[str] | None = None) -> DataFrame:
    """(scope, query_id, vec_id, cosine, rank): exact cosine top-k of (query_id, query) among (vec_id, vec), decimals as reported.

    With ``scope``, names of columns that both sides have (owner, model, dimensions, ...), only vectors of a query's own scope count.

    Both sides may have a ``label``; then only vectors with the label of the query count.  Queries of a checked size travel to the tasks;
    beyond, blocks of about ``VECTOR_BLOCK`` vectors are held by a task each while blocks of queries stream past.  Either way vectors are
    never copied, and a task passes on its best ``k`` for each query."""
    labelled = "label" in vectors.columns and "label" in queries.columns
    names = [[F.col("label").alias(n)] if labelled else [] for n in ("query_label", "vec_label")]
    left, right = queries.select("query_id", "query", *names[0]), vectors.select("vec_id", "vec", *names[1])
    found = "query_id bigint, vec_id bigint, _c double"

    def table(columns: list) -> pa.Table:
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "_c"])

    if scope:

        def within(block: pa.Table, asked: pa.Table) -> pa.Table:
            return table(nearest(asked.rename_columns({"id": "query_id", "value": "query"}), block.rename_columns({"id": "vec_id", "value": "vec"}), k))

        held = vectors.select(*scope, F.col("vec_id").alias("id"), F.col("vec").alias("value"))
        found_here = _past_scopes(held, queries.select(*scope, F.col("query_id").alias("id"), F.col("query").alias("value")), scope, VECTOR_BLOCK, within, found)
        return _ranked_vectors(found_here, scope, k)
    size = left.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("query")), F.lit(0)).alias("numbers")).first()
    if size["rows"] <= VECTOR_BLOCK and size["numbers"] <= VECTOR_NUMBERS:
        asked = left.toArrow()

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                if batch.num_rows and asked.num_rows:
                    new = nearest(asked, pa.Table.from_batches([batch]), k)
                    best = new if best is None else _best_of([np.concatenate(x) for x in zip(best, new, strict=True)], k)
            if best is not None:
                yield from table(best).to_batches()

        best = right.mapInArrow(local, found)
    else:

        def scored(block: pa.Table, parts: Iterator[pa.Table]) -> Iterator[pa.Table]:
            held = pa.Table.from_struct_array(_one(block["value"]))
            held = held.append_column("vec_id", block["id"])
            for part in parts:
                asked = pa.Table.from_struct_array(_one(part["value"])).append_column("query_id", part["id"])
                yield table(nearest(asked.rename_columns([_QUERY_NAMES.get(n, n) for n in asked.column_names]), held, k))

        value = ["vec", *(["vec_label"] if labelled else [])]
        passing = left.select(F.col("query_id").alias("id"), F.struct(F.col("query").alias("vec"), *([F.col("query_label").alias("vec_label")] if labelled else [])).alias("value"))
        held = right.select(F.col("vec_id").alias("id"), F.struct(*value).alias("value"))
        best = _past_blocks(held, max(1, -(-vectors.count() // VECTOR_BLOCK)), passing, max(1, -(-size["rows"] // VECTOR_BLOCK), -(-size["numbers"] // VECTOR_NUMBERS)), scored, found)
    return _ranked_vectors(best, [], k)


def _ranked_vectors(best: DataFrame, scope: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*scope, "query_id").orderBy(F.desc("cosine"), "vec_id")
    scored = best.select(*scope, "query_id", "vec_id", F.round("_c", 6).alias("cosine"))
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


_QUERY_NAMES = {"vec": "query", "vec_label": "query_label"}


def _best_of(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The best ``k`` of [query_id, vec_id, cosine] for each query, in the order of the reported decimals, then the id."""
    key = np.where(np.isnan(found[2]), np.inf, np.copysign(np.floor(np.abs(found[2]) * 1e6 + 0.5), found[2]))
    order = np.lexsort((found[1], -key, found[0]))
    found = [x[order] for x in found]
    place = np.arange(len(order)) - np.searchsorted(found[0], found[0])
    return [x[place < k] for x in found]


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as rows, their dimensions); vectors that are null, hold a null or have no length are zero."""
    lists = [[] if x is None or None in x else x for x in column.to_pylist()] if _ragged(column) else None
    if lists is None:
        flat = column.combine_chunks().flatten().to_numpy()
        rows = flat.reshape(len(column), len(flat) // len(column)).astype(np.float64)
        sizes = np.full(len(rows), rows.shape[1])
    else:
        sizes = np.array([len(x) for x in lists])
        rows = np.zeros((len(lists), max(sizes.max(), 1)))
        for row, x in zip(rows, lists, strict=True):
            row[: len(x)] = x
    norms = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms != 0), sizes


def _ragged(column: pa.ChunkedArray) -> bool:
    sizes = pc.list_value_length(column)
    return column.null_count > 0 or pc.min(sizes).as_py() != pc.max(sizes).as_py() or column.combine_chunks().flatten().null_count > 0


def nearest(queries: pa.Table, vectors: pa.Table, k: int) -> list[np.ndarray]:
    """[query_id, vec_id, cosine] of the best ``k`` vectors of each query, in the order of the reported decimals, then the id."""
    (q, q_size), (v, v_size) = _matrix(queries["query"]), _matrix(vectors["vec"])
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
    query_ids, ids = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy()
    labels = None
    if "query_label" in queries.column_names:
        codes = pa.chunked_array([*vectors["vec_label"].chunks, *queries["query_label"].chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        labels = codes[: len(v)], codes[len(v) :]
    best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]  # row of the query, vec_id, key, cosine
    step = max(1, PAIRS // len(q))
    for at in range(0, len(v), step):
        part = slice(at, at + step)
        cosine = v[part] @ q.T
        cosine[v_size[part, None] != q_size] = 0.0
        key = np.where(np.isnan(cosine), np.inf, np.copysign(np.floor(np.abs(cosine) * 1e6 + 0.5), cosine))
        wrong = ids[part, None] == query_ids
        if labels is not None:
            wrong |= (labels[0][part, None] != labels[1]) | (labels[1] < 0)
        key[wrong] = -np.inf
        n = len(key)
        keep = key > -np.inf
        if n > k:
            keep &= key >= np.partition(key, n - k, axis=0)[n - k]
        row, col = np.nonzero(keep)
        best = [np.concatenate(x) for x in zip(best, (col, ids[part][row], key[row, col], cosine[row, col]), strict=True)]
        order = np.lexsort((best[1], -best[2], best[0]))
        best = [x[order] for x in best]
        place = np.arange(len(order)) - np.searchsorted(best[0], best[0])
        best = [x[place < k] for x in best]
    return [query_ids[best[0]], best[1], best[3]]


def tokens_of(df: DataFrame, id_col: str, text_col: str, as_id: str) -> DataFrame:
    return df.select(F.col(id_col).alias(as_id), text.retrieval_tokens(F.col(text_col)).alias("tokens"))
