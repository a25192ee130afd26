"""SentencePiece encoding and decoding over tables of distinct chunks.

Where no piece of the vocabulary holds a whitespace marker after another character, merges never cross into the next
marker.  A text then falls into chunks, each a run of markers with the word behind it, and the ids of the text are the
ids of its chunks one after another, joined back by position with one vectorised gather.  There are two ways to the table:

* ``tasks``: a task keeps a table of the distinct chunks it has met and segments each of them once through the library.  The
  table is emptied at ``table_size`` entries or ``TABLE_CHARS`` characters: results do not depend on its size, and its memory is
  bounded.  Nothing is shuffled, but a chunk is segmented once for each task and table.
* ``table``: Spark makes the chunks distinct over all texts, each is segmented once overall, and the table (chunk, ids) is joined
  back: texts are dealt into blocks of about ``BLOCK_CHARS`` characters by a hash, the distinct chunks of a block are joined to the
  table, and each block meets its part of the table in one group.  Texts are moved once, and one block is in memory at a time.

The queries take the first way; the README has the figures of both.

A vocabulary in which a piece does cross a marker, or whose normaliser rewrites text, is encoded text by text instead.

Null counts as the empty text, which has no ids and decodes to the empty text.  Very long texts and very long chunks are encoded whole.
Rows that repeat, share an id or have none are encoded each for itself.  An empty table gives no rows.  Extra columns of the
input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import store

MARK = "▁"
RESULT = "ids array<int>, decoded string"
#: Characters that a task's table holds at most before it is emptied: text without spaces has few, but long chunks.
TABLE_CHARS = 16_000_000
BLOCK_CHARS = 16_000_000
#: Distinct chunks that a task remembers to have listed: beyond, it forgets them and may list some again.
LISTED = 300_000


@lru_cache(maxsize=4)
def processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@lru_cache(maxsize=4)
def chunks_are_independent(model_path: str) -> bool:
    """True if markers only start pieces and normalising is nothing but marking spaces behind a dummy prefix."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    return (
        model.trainer_spec.model_type == model.trainer_spec.BPE
        and not model.trainer_spec.treat_whitespace_as_suffix
        and rules.add_dummy_prefix
        and rules.escape_whitespaces
        and not rules.remove_extra_whitespaces
        and not rules.precompiled_charsmap
        and not any(p.type == p.USER_DEFINED or MARK in p.piece.lstrip(MARK) for p in model.pieces)
    )


def split_chunks(text: str) -> list[str]:
    """The chunks of a text without their first marker, other markers as spaces; "" is a marker alone."""
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    chunks, run = [], 0
    for word in words[:-1]:
        if word:
            chunks.append(" " * run + word)
            run = 0
        else:
            run += 1
    chunks.append(" " * run + words[-1])
    return chunks


class Pieces:
    """What each id stands for, as flat bytes that a gather can join."""

    def __init__(self, model_path: str):
        self.sp = sp = processor(model_path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [
            bytes([int(n[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else n.replace(MARK, " ").encode()
            for i, n in enumerate(names)
        ]
        self.lengths = np.array([len(x) for x in plain], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.marked = np.array([n.startswith(MARK) for n in names])
        self.mark = sp.piece_to_id(MARK)

    def surface(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(the text of all ids in UTF-8, number of bytes of each id)."""
        lengths = self.lengths[ids]
        return self.bytes[ragged(self.starts[ids], lengths)].tobytes(), lengths


@lru_cache(maxsize=4)
def pieces_of(model_path: str) -> Pieces:
    return Pieces(model_path)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... (lengths[i] of them) for all i in order."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def segment(chunks: list[str], model_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all chunks one after another, number of ids of each): those with one marker in a few calls, told apart by their markers."""
    pieces = pieces_of(model_path)
    single = np.array([c != "" and c[0] != " " for c in chunks], bool)
    words = list(compress(chunks, single))
    # in lines of some hundred words: the merges of one very long line would fall out of the processor's caches
    lines = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
    ids = np.concatenate([np.empty(0, np.int32)] + [np.array(x, np.int32) for x in pieces.sp.encode(lines, num_threads=1)])
    starts, lengths = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
    starts[single] = np.flatnonzero(pieces.marked[ids])
    lengths[single] = np.diff(np.append(starts[single], len(ids)))
    parts, used = [ids], len(ids)
    for at in np.flatnonzero(~single):
        # The library leaves an empty input without a marker; the chunk "" is one marker.
        own = np.array(pieces.sp.encode(chunks[at]) if chunks[at] else [pieces.mark], np.int32)
        parts.append(own)
        starts[at], lengths[at] = used, len(own)
        used += len(own)
    return np.concatenate(parts)[ragged(starts, lengths)], lengths


class ChunkTable:
    """Distinct chunks, numbered as they are met, with the place of their ids in one flat array; emptied at a size, if it has one."""

    def __init__(self, model_path: str, size: int | None = None):
        self.model_path, self.size = model_path, size
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat = np.empty(0, np.int32)
        self.starts = self.lengths = np.empty(0, np.int64)
        self.chars = 0

    def add(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the newest chunks."""
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])
        self.chars += sum(map(len, chunks))

    @classmethod
    def of(cls, table: pa.Table, model_path: str) -> ChunkTable:
        """From the columns chunk and ids, without repeats."""
        out, ids, chunks = cls(model_path), table["ids"].combine_chunks(), table["chunk"].to_pylist()
        for chunk in chunks:
            out.index[chunk]
        out.add(chunks, ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()).astype(np.int64))
        return out

    def ids(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, number of ids of each), given each one's chunks."""
        known, at = len(self.index), self.index.__getitem__
        codes = np.fromiter(chain.from_iterable(map(at, chunks) for chunks in documents), np.int64)
        if len(self.index) > known:
            new = list(islice(self.index, known, None))
            self.add(new, *segment(new, self.model_path))
        lengths = self.lengths[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.cumsum([len(chunks) for chunks in documents]).astype(np.int64)
        counts = np.diff(np.concatenate([[0], ends[stops]]))
        got = self.flat[ragged(self.starts[codes], lengths)].astype(np.int32)
        if self.size is not None and (len(self.index) > self.size or self.chars > TABLE_CHARS):
            self.clear()
        return got, counts


def decode_ids(ids: np.ndarray, counts: np.ndarray, model_path: str) -> list[str]:
    """The library's decode() of each of the id lists that lie one after another in ``ids``."""
    pieces = pieces_of(model_path)
    joined, lengths = pieces.surface(ids)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    stops = np.cumsum(counts)
    texts = []
    for start, stop in zip((stops - counts).tolist(), stops.tolist(), strict=True):
        own = joined[ends[start] : ends[stop]]
        try:
            # decode() leaves out the marker that the dummy prefix put before the text
            texts.append((own[1:] if own[:1] == b" " and pieces.marked[ids[start]] else own).decode())
        except UnicodeDecodeError:  # bytes that are no text; the library says what stands for them
            texts.append(pieces.sp.decode(ids[start:stop].tolist()))
    return texts


def encode_texts(texts: pa.Array, table: ChunkTable | None, model_path: str, block_chars: int = 1_000_000) -> pa.StructArray:
    """Ids and decoded text of each text; works through blocks of texts so that scratch arrays stay small."""
    ids, counts, decoded, block = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [], []

    def flush() -> None:
        if block:
            own, sizes = table.ids(block)
            ids.append(own)
            counts.append(sizes)
            decoded.extend(decode_ids(own, sizes, model_path))
            block.clear()

    waiting = 0
    for value in texts:
        text = value.as_py() or ""
        if table is None:
            ids.append(np.array(processor(model_path).encode(text), np.int32))
            counts.append(np.array([len(ids[-1])]))
            decoded.append(processor(model_path).decode(ids[-1].tolist()))
            continue
        block.append(split_chunks(text) if text else [])
        waiting += len(text)
        if waiting >= block_chars:
            flush()
            waiting = 0
    flush()
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)  # a batch has at most some MB of text
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
    return pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], names=["ids", "decoded"])


def distinct_chunks(df: DataFrame, text_col: str) -> DataFrame:
    """(chunk) of all texts, without repeats."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            new: set[str] = set()
            for value in batch.column(0):
                text = value.as_py()
                if text:
                    new.update(split_chunks(text))
            new -= seen
            if len(seen) > LISTED:
                seen = set()
            seen |= new
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], names=["chunk"])

    return df.select(F.col(text_col).alias("_t")).mapInArrow(listed, "chunk string").distinct()


def chunk_table(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(chunk, ids) of the distinct chunks of all texts, each segmented once."""

    @F.arrow_udf("array<int>")
    def segmented(chunks: pa.Array) -> pa.Array:
        ids, lengths = segment(chunks.to_pylist(), model_path)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids))

    return distinct_chunks(df, text_col).select("chunk", segmented("chunk").alias("ids"))


def codec(model_path: str, table_size: int = 400_000) -> Callable[[Column], Column]:
    """A column function text -> struct<ids, decoded>, equal to the library's encode and decode of the whole text."""

    @F.arrow_udf(RESULT)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(model_path, table_size) if chunks_are_independent(model_path) else None
        for texts in batches:
            yield encode_texts(texts, table, model_path)

    return encode


def joined_by_blocks(rows: DataFrame, chunks: DataFrame, model_path: str, chars: int) -> DataFrame:
    """Rows (_id, _t) with ids and decoded, from a chunk table of any size."""
    spark = rows.sparkSession
    blocks = max(1, -(-chars // BLOCK_CHARS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    dealt = rows.select("_id", "_t", F.pmod(F.xxhash64("_id", "_t"), F.lit(blocks)).cast("int").alias("block")).repartition(parts, "block")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {}  # all of the blocks of this task: a block must not list a chunk twice
        for batch in batches:
            new: dict[int, set[str]] = {}
            for block, value in zip(batch.column("block").to_pylist(), batch.column("_t"), strict=True):
                text = value.as_py()
                if text:
                    new.setdefault(block, set()).update(split_chunks(text))
            for block, own in new.items():
                own -= seen.setdefault(block, set())
                seen[block] |= own
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block, np.int32)), pa.array(list(own), pa.string())], names=["block", "chunk"])

    def join(texts: pa.Table, own: pa.Table) -> pa.Table:
        table = ChunkTable.of(own, model_path)
        coded = [encode_texts(part, table, model_path) for part in texts["_t"].chunks] or [encode_texts(pa.array([], pa.string()), table, model_path)]
        coded = pa.concat_arrays(coded)
        return pa.table([texts["_id"], coded.field("ids"), coded.field("decoded")], names=["_id", "ids", "decoded"])

    needs = dealt.mapInArrow(needed, "block int, chunk string")
    own = needs.join(chunks, "chunk").select("block", "chunk", "ids").repartition(parts, "block")
    kind = rows.schema["_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(join, f"_id {kind}, {RESULT}")


def encode_documents(df: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", way: str = "tasks") -> DataFrame:
    """(id, ids, decoded) of every row, by the way ``tasks`` or ``table``; ``id_col`` may be a struct."""
    store.bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    if way == "tasks" or not chunks_are_independent(model_path):
        return rows.select(F.col("_id").alias(id_col), codec(model_path)("_t").alias("_r")).select(id_col, "_r.*")
    chunks = store.table(chunk_table(rows, model_path, "_t"), "chunks")
    chars = rows.agg(F.sum(F.length("_t"))).first()[0] or 0
    return joined_by_blocks(rows, chunks, model_path, chars).withColumnRenamed("_id", id_col)
