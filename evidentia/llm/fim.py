"""Fill-in-middle transformation by a parallel automaton scan.

Texts are cut into tokens (whitespace with the word behind it, or whitespace at the end) by an automaton of three states.  A chunk
of a text is scanned from every state at once and tells, for each, the state in which it ends and how many tokens it closes.
Such functions compose associatively, so a scan by doubling gives every chunk its entry state and the tokens closed before it.  The
cut behind the k-th token lies in the first chunk whose running count reaches k; only that chunk is read again.

The same two functions (``scan`` and ``running``) work at two levels.  Within a task all chunks of a batch are scanned in step.
A document of more than ``GIANT_CHARS`` code points is dealt over the cluster in pieces of ``PIECE_CHARS``: each piece is scanned
where it lies, the functions of a document's pieces (some hundreds, as a Spark value has 2 GB at most) are composed, the pieces
that hold cuts are read again, and the parts of the output are put in order.  Both levels give the same rows.

Null texts are empty, empty texts are plain and have no tokens.  A null id hashes as no digits.  Texts that hold a sentinel are plain, whole texts
are read at any length, and rows that repeat are each transformed alike.  An empty table gives no rows.  Extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import store

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_SHARE, SPM_SHARE = 50, 80
CHUNK = 512
PIECE_CHARS = 1 << 20
GIANT_CHARS = 1 << 23

#: States: nothing since the last token, in whitespace, in a word.  Columns: whitespace, another character.
BETWEEN, SPACE, WORD = range(3)
NEXT = np.array([[SPACE, WORD], [SPACE, WORD], [SPACE, WORD]], np.uint8)
CLOSES = np.array([[0, 0], [0, 0], [1, 0]], np.uint8)


def classes(text: str) -> np.ndarray:
    """0 for each whitespace character, 1 for another."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return 1 - ((codes == 32) | ((codes >= 9) & (codes <= 13))).astype(np.uint8)


def scan(kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state at the end, tokens closed) of each chunk from each state, as arrays (chunks, states).

    All chunks advance one character a step; chunks in the order of their length, so that those that have ended are left behind."""
    order = np.argsort(-lengths, kind="stable")
    begin, left = starts[order], lengths[order]
    state = np.repeat(np.arange(len(NEXT), dtype=np.uint8)[:, None], len(order), axis=1)
    closed = np.zeros(state.shape, np.int64)
    for step, active in enumerate(_active(left)):
        at = state[:, :active] * 2 + kinds[begin[:active] + step]
        closed[:, :active] += CLOSES.ravel()[at]
        state[:, :active] = NEXT.ravel()[at]
    back = np.argsort(order, kind="stable")
    return state.T[back], closed.T[back]


def _active(lengths: np.ndarray) -> Iterator[int]:
    """How many of the chunks, in falling order of length, are longer than 0, 1, 2, ..."""
    if len(lengths):
        yield from np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()


def running(ends: np.ndarray, closed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state at the end, tokens closed) from the first chunk of the document to each chunk, composed by doubling; ``place`` numbers the chunks of a document from 0."""
    ends, closed = ends.copy(), closed.copy()
    width = 1
    while width <= (place.max() if len(place) else 0):
        later = np.flatnonzero(place >= width)
        before, over = ends[later - width], closed[later - width]
        ends[later], closed[later] = np.take_along_axis(ends[later], before, 1), over + np.take_along_axis(closed[later], before.astype(np.int64), 1)
        width *= 2
    return ends[:, BETWEEN], closed[:, BETWEEN]


def find(kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where each chunk, entered in its state, closes its ``rank``-th token."""
    order = np.argsort(-lengths, kind="stable")
    begin, state, left, found = starts[order], entry[order].astype(np.uint8), rank[order].copy(), np.full(len(order), -1, np.int64)
    for step, active in enumerate(_active(lengths[order])):
        at = state[:active] * 2 + kinds[begin[:active] + step]
        closes = CLOSES.ravel()[at]
        left[:active] -= closes
        found[:active][(closes == 1) & (left[:active] == 0)] = step
        state[:active] = NEXT.ravel()[at]
    out = np.empty_like(found)
    out[order] = found
    return out


def cuts(texts: list[str], first: np.ndarray, second: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, end of prefix, end of middle) of each text, both in code points; the cuts lie behind ``first`` and ``second`` modulo tokens + 1 tokens."""
    sizes = np.array([len(t) for t in texts], np.int64)
    kinds = classes("".join(texts))
    n_chunks = -(-sizes // chunk)
    doc = np.repeat(np.arange(len(texts)), n_chunks)
    first_chunk = np.cumsum(n_chunks) - n_chunks
    place = np.arange(len(doc)) - first_chunk[doc]
    starts = (np.cumsum(sizes) - sizes)[doc] + place * chunk
    lengths = np.minimum(chunk, sizes[doc] - place * chunk)
    state, closed = running(*scan(kinds, starts, lengths), place)
    last = first_chunk + n_chunks - 1
    tokens = np.where(n_chunks > 0, closed[last] + (state[last] != BETWEEN), 0) if len(doc) else np.zeros(len(texts), np.int64)
    at = np.sort(np.stack([first % (tokens + 1), second % (tokens + 1)]), axis=0)
    ends = np.where(at == tokens, sizes, 0)
    side, row = np.nonzero((at > 0) & (at < tokens))
    if len(row):
        per_doc = doc * (closed.max() + 1) + closed  # grows over all chunks
        chosen = np.searchsorted(per_doc, row * (closed.max() + 1) + at[side, row], side="left")
        entry = np.where(place[chosen] > 0, state[chosen - 1], BETWEEN)
        before = np.where(place[chosen] > 0, closed[chosen - 1], 0)
        inner = find(kinds, starts[chosen], lengths[chosen], entry, at[side, row] - before)
        ends[side, row] = place[chosen] * chunk + inner
    return tokens, ends[0], ends[1]


def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = cuts(texts.to_pylist(), first.to_numpy(), second.to_numpy())
    return pa.StructArray.from_arrays([pa.array(x) for x in found], names=["n", "first", "second"])


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32 for each id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def form(text: Column, third: Column, fourth: Column, fim_share: int, spm_share: int) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (F.length(text) == 0) | marked | (third % 100 >= fim_share)
    return F.when(plain, "plain").when(fourth % 100 < spm_share, "spm").otherwise("psm")


def arranged(kind: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    p, s, m = map(F.lit, (PREFIX, SUFFIX, MIDDLE))
    return F.when(kind == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(kind == "spm", F.concat(s, suffix, p, prefix, m, middle))


def restore(output: Column, kind: Column) -> Column:
    """The text of an output: what stands behind each sentinel, in the order of the text.

    No sentinel can arise where parts meet, as each begins with the only '<' it has, so the first of each kind is the true one."""
    body, middle = F.substring(output, len(PREFIX) + 1, 2**31 - 1), F.substring_index(output, MIDDLE, -1)
    psm = (F.substring_index(body, SUFFIX, 1), F.substring_index(F.substring_index(output, SUFFIX, -1), MIDDLE, 1))
    spm = (F.substring_index(F.substring_index(output, PREFIX, -1), MIDDLE, 1), F.substring_index(body, PREFIX, 1))
    return F.when(kind == "psm", F.concat(psm[0], middle, psm[1])).when(kind == "spm", F.concat(spm[0], middle, spm[1])).otherwise(output)


def transform(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "42",
    fim_share: int = FIM_SHARE,
    spm_share: int = SPM_SHARE,
    giant_chars: int = GIANT_CHARS,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; the two lengths are null where the form is plain."""
    store.bound_batches(df.sparkSession)
    one, two, three, four = draws(F.col(id_col), seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("t"), one.alias("h1"), two.alias("h2"), form(text, three, four, fim_share, spm_share).alias("form"))
    giant = F.length("t") > giant_chars
    found = rows.filter(~giant).withColumn("c", F.arrow_udf(_cuts, "struct<n: bigint, first: bigint, second: bigint>")("t", "h1", "h2"))
    first, second = F.col("c.first").cast("int"), F.col("c.second").cast("int")
    parts = F.substring(F.col("t"), F.lit(1), first), F.substring(F.col("t"), first + 1, second - first), F.substring(F.col("t"), second + 1, F.length("t"))
    small = found.select("id", "c.n", "form", *_lengths(F.col("c.first"), F.col("c.second")), F.coalesce(arranged(F.col("form"), *parts), F.col("t")).alias("output"))
    return small.union(_giants(rows.filter(giant), piece_chars)).withColumnRenamed("id", id_col)


def _lengths(first: Column, second: Column) -> tuple[Column, Column]:
    plain = F.col("form") == "plain"
    return F.when(~plain, first).alias("prefix_chars"), F.when(~plain, second - first).alias("middle_chars")


def _giants(rows: DataFrame, piece_chars: int) -> DataFrame:
    """The result for giant documents, dealt over the cluster in pieces."""
    pieces = store.table(_pieces(rows, piece_chars), "fim-pieces")
    functions = pieces.select("row", "piece", "h1", "h2", F.arrow_udf(_function, "struct<ends: array<tinyint>, closed: array<bigint>, chars: bigint>")("t").alias("f"))
    placed = functions.groupBy("row").applyInArrow(_composed, PLACED)
    inside = placed.filter("ranks[0] > 0 OR ranks[1] > 0").join(pieces.select("row", "piece", "t"), ["row", "piece"])
    search = F.arrow_udf(_found, "array<struct<first: bigint, second: bigint>>")
    found = inside.select("row", F.explode(search("t", "entry", "before_chars", "ranks")).alias("cut"))
    found = found.groupBy("row").agg(F.max("cut.first").alias("_1"), F.max("cut.second").alias("_2"))
    placed = placed.join(found, "row", "left")
    ends = [F.greatest(F.col("ends")[i], F.coalesce(F.col(f"_{i + 1}"), F.lit(0))) for i in range(2)]
    placed = placed.select("row", "piece", "n", "before_chars", ends[0].alias("first"), ends[1].alias("second"))
    joined = pieces.join(placed, ["row", "piece"])
    edges = [F.least(F.greatest(F.col(x) - F.col("before_chars"), F.lit(0)), F.length("t").cast("bigint")).cast("int") for x in ("first", "second")]
    prefix, middle = F.substring(F.col("t"), F.lit(1), edges[0]), F.substring(F.col("t"), edges[0] + 1, edges[1] - edges[0])
    suffix = F.substring(F.col("t"), edges[1] + 1, F.length("t"))
    whole = joined.groupBy("row", "id", "form", "n", "first", "second").agg(F.array_sort(F.collect_list(F.struct("piece", prefix.alias("p"), middle.alias("m"), suffix.alias("s")))).alias("parts"))
    p, m, s = (F.array_join(f"parts.{n}", "") for n in "pms")
    output = F.coalesce(arranged(F.col("form"), p, m, s), F.concat(p, m, s))
    return whole.select("id", "n", "form", *_lengths(F.col("first"), F.col("second")), output.alias("output"))


def _pieces(rows: DataFrame, piece_chars: int) -> DataFrame:
    """(row, piece, t) and the other columns, each piece of a text with the number that orders it; ``row`` names the row by its place in the scan."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(batch.num_rows):
                text, rest = batch.column("t")[i].as_py(), batch.slice(i, 1).drop_columns(["t"])
                for piece, at in enumerate(range(0, len(text), piece_chars)):
                    columns = [pa.array([f"{part}-{number}"]), pa.array([piece], pa.int32()), *rest.columns, pa.array([text[at : at + piece_chars]])]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "piece", *rest.schema.names, "t"])
                number += 1

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rest = ", ".join(f"{name} {kind}" for name, kind in kinds.items() if name != "t")
    return rows.mapInArrow(cut, f"row string, piece int, {rest}, t string").repartition("row", "piece")


def _function(texts: pa.Array) -> pa.Array:
    """The function of each piece, composed from those of its chunks."""
    rows = []
    for text in texts.to_pylist():
        kinds = classes(text)
        starts = np.arange(0, len(kinds), CHUNK)
        ends, closed = scan(kinds, starts, np.minimum(CHUNK, len(kinds) - starts))
        state, count = np.arange(len(NEXT)), np.zeros(len(NEXT), np.int64)
        for e, c in zip(ends, closed, strict=True):
            state, count = e[state], count + c[state]
        rows.append({"ends": state.tolist(), "closed": count.tolist(), "chars": len(kinds)})
    return pa.array(rows, pa.struct([("ends", pa.list_(pa.int8())), ("closed", pa.list_(pa.int64())), ("chars", pa.int64())]))


PLACED = "row string, piece int, n bigint, entry tinyint, before_chars bigint, ranks array<bigint>, ends array<bigint>"


def _composed(table: pa.Table) -> pa.Table:
    """Of each piece of a document: entry state, characters before it, and which of its tokens end the prefix and the middle (0: none);
    ``ends`` has those cuts that need no search."""
    table = table.sort_by("piece")
    functions = table["f"].to_pylist()
    place = np.arange(len(functions))
    state, closed = running(np.array([f["ends"] for f in functions], np.uint8), np.array([f["closed"] for f in functions]), place)
    chars = np.cumsum([f["chars"] for f in functions])
    n = int(closed[-1] + (state[-1] != BETWEEN))
    at = sorted(table[h][0].as_py() % (n + 1) for h in ("h1", "h2"))
    ranks = np.zeros((len(place), 2), np.int64)
    for side, k in enumerate(at):
        if 0 < k < n:
            chosen = int(np.searchsorted(closed, k))
            ranks[chosen, side] = k - (closed[chosen - 1] if chosen else 0)
    ends = [int(chars[-1]) if k == n else 0 for k in at]
    entry, before = np.concatenate([[BETWEEN], state[:-1]]), np.concatenate([[0], chars[:-1]])
    columns = [table["row"], table["piece"], pa.array([n] * len(place)), pa.array(entry, pa.int8()), pa.array(before), pa.array(ranks.tolist()), pa.array([ends] * len(place))]
    return pa.table(columns, names=["row", "piece", "n", "entry", "before_chars", "ranks", "ends"])


def _found(texts: pa.Array, entry: pa.Array, before: pa.Array, ranks: pa.Array) -> pa.Array:
    """The places, from the beginning of the document, of the cuts that lie in each piece."""
    rows = []
    for text, state, chars, wanted in zip(texts.to_pylist(), entry.to_pylist(), before.to_pylist(), ranks.to_pylist(), strict=True):
        kinds, sides = classes(text), [side for side in range(2) if wanted[side]]
        starts, lengths = np.zeros(len(sides), np.int64), np.full(len(sides), len(kinds))
        places = find(kinds, starts, lengths, np.full(len(sides), state), np.array([wanted[s] for s in sides])) + chars
        rows.append([{"first": None, "second": None, ("first", "second")[side]: int(p)} for side, p in zip(sides, places, strict=True)])
    return pa.array(rows, pa.list_(pa.struct([("first", pa.int64()), ("second", pa.int64())])))
