"""Which of many terms many texts contain, in one pass over each text.

Within a group (an owner, say) distinct terms become an automaton that finds all of them in a text at once, so the work grows with
the texts and with what is found, not with terms times texts.  A group's texts are dealt into cells of about ``TEXTS`` rows and its terms
into blocks of about ``TERMS``; a cell of texts meets each block.  A task holds one block's automaton and its counts while texts stream
by, so a group with a third of all texts is many tasks.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS, TERMS = 20_000, 20_000
BATCH = 4096


def _cells(df: DataFrame, group: str, per_cell: int, name: str) -> DataFrame:
    return df.groupBy(group).agg(F.ceil(F.count("*") / per_cell).cast("int").alias(name))


def _dealt(terms: DataFrame, texts: DataFrame, group: str, term: str, body: str, key: Column, texts_per_cell: int, terms_per_cell: int) -> DataFrame:
    """(group, _i, _j, _side, _word, _key): each cell's terms (side 0), then its texts (side 1), in one partition."""
    wanted = terms.filter(F.col(term) != "").select(group, F.col(term).alias("_word")).distinct()
    own = texts.filter(F.col(body).isNotNull()).select(group, F.col(body).alias("_word"), key.alias("_key"))
    sizes = _cells(wanted, group, terms_per_cell, "_blocks").join(_cells(own, group, texts_per_cell, "_parts"), group)
    nothing = F.lit(None).cast(own.schema["_key"].dataType).alias("_key")
    left = wanted.join(sizes, group).select(
        group, F.pmod(F.xxhash64("_word"), F.col("_blocks")).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_j"), F.lit(0).alias("_side"), "_word", nothing,
    )
    right = own.join(sizes, group).select(
        group, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_i"), F.pmod(F.xxhash64("_key", "_word"), F.col("_parts")).cast("int").alias("_j"), F.lit(1).alias("_side"), "_word", "_key",
    )
    return left.union(right).repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j", "_side")


def count_texts(terms: DataFrame, texts: DataFrame, group: str, term: str, body: str, row: Column, texts_per_cell: int = TEXTS, terms_per_cell: int = TERMS) -> DataFrame:
    """(group, term, records): in how many texts of its group each term occurs anywhere; terms that occur in none are left out.

    ``row`` tells the rows of ``texts`` apart and deals them; null and empty terms, null texts and null groups count for nothing."""
    dealt = _dealt(terms, texts, group, term, body, row, texts_per_cell, terms_per_cell)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, owner, words, hits in _passes(batches):
            found: Counter[int] = Counter()
            for _, own in hits:
                found.update(own)
            rows = list(found.items())
            for at in range(0, len(rows), BATCH):
                part = rows[at : at + BATCH]
                columns = [pa.array([owner] * len(part), kind), pa.array([words[i] for i, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "term", "records"])

    counts = dealt.mapInArrow(counted, f"{group} {terms.schema[group].dataType.simpleString()}, {term} string, records bigint")
    return counts.groupBy(group, term).agg(F.sum("records").alias("records"))


def terms_in_texts(terms: DataFrame, texts: DataFrame, group: str, term: str, body: str, keys: list[str], texts_per_cell: int = TEXTS, terms_per_cell: int = TERMS) -> DataFrame:
    """(group, keys, term): a row for each text, told by its keys, and each term of its group that occurs anywhere in it."""
    dealt = _dealt(terms, texts, group, term, body, F.struct(*keys), texts_per_cell, terms_per_cell)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, owner, words, hits in _passes(batches):
            held: list[tuple] = []
            for key, own in hits:
                held += [(key, words[i]) for i in own]
                if len(held) >= BATCH:
                    yield rows_of(kind, owner, held)
                    held = []
            if held:
                yield rows_of(kind, owner, held)

    def rows_of(kind: pa.DataType, owner, held: list[tuple]) -> pa.RecordBatch:
        keys_of = pa.concat_arrays([k for k, _ in held])
        return pa.RecordBatch.from_arrays([pa.array([owner] * len(held), kind), keys_of, pa.array([w for _, w in held], pa.string())], names=["group", "key", "term"])

    kind = dealt.schema["_key"].dataType.simpleString()
    found = dealt.mapInArrow(listed, f"{group} {terms.schema[group].dataType.simpleString()}, _key {kind}, {term} string")
    return found.select(group, "_key.*", term)


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(type of the group, group, words, (key of a text, numbers of the words in it) of the cell's texts) of each cell, streamed."""
    rows = ((b.column(0).type, g, (i, j), side, word, b.column(5).slice(n, 1)) for b in batches for n, (g, i, j, side, word) in enumerate(zip(*(c.to_pylist() for c in b.columns[:5]), strict=True)))
    for (_, owner, _), cell in itertools.groupby(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        first = next(cell)
        kind, words, ahead = first[0], [], first
        while ahead is not None and ahead[3] == 0:
            words.append(ahead[4])
            ahead = next(cell, None)
        if ahead is not None and words:
            finder = automaton(words)
            texts = itertools.chain([ahead], cell)
            yield kind, owner, words, ((key, {i for _, i in finder.iter(text)}) for *_, text, key in texts)


def automaton(words: list[str]) -> ahocorasick.Automaton:
    """Finds the numbers of the words that a text contains."""
    made = ahocorasick.Automaton()
    for i, word in enumerate(words):
        made.add_word(word, i)
    made.make_automaton()
    return made
