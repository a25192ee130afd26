"""Mixing sources to target weights.

Every document gets a hash-random key.  Within its source documents are sorted by key, in ranges: the leading hex digits of
the key cut each source into ``16 ** digits`` ranges of like size, whose word counts are summed first.  The prefix sum of a
document is the sum of the ranges before its own plus the running sum within its range, so a source with a third of all
rows is worked on by as many tasks as there are ranges.  A source's budget is cut exactly: whole epochs, then the documents
whose prefix lies below the rest, of which the last is cut at the word.

The tables over sources (one row each) are small by the number of sources and never leave Spark.

Null texts have no words and null sources are one source; very long texts are counted whole, and cut at a word like others.
Rows that tie in their key follow one another by id and size; rows that repeat are each a document of the mix.  An empty
table gives no rows.  Extra columns, whatever their names, are not read (``take`` returns them as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import groups

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with ``target``: ``share`` of all sizes dealt by weight, at most ``max_epochs`` sizes each.

    Weights go round over the sources by code point, null last.  Dealing the excess of full sources among the others again
    and again ends at min(max_epochs * size, level * weight) with one level for all, which is found by taking sources in the
    order in which they fill up: the level is the largest of (what is left) / (weights left) along that order.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sources.withColumn("weight", weight).withColumn("_cap", F.lit(max_epochs) * F.col("source_size"))
    ranked = ranked.withColumn("_fills_at", F.col("_cap").cast("double") / F.col("weight"))
    fill = Window.partitionBy(F.lit(0)).orderBy("_fills_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    ranked = ranked.withColumn("_level", left / F.sum("weight").over(after))
    level = F.max("_level").over(every)
    target = F.least(F.col("_cap").cast("double"), level * F.col("weight"))
    return ranked.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    digits: int = 3,
) -> DataFrame:
    """(id, source, size, source_size, target, taken) for every row of ``df``.

    ``taken`` counts the words that the mix takes of a document, repeats included; the sum over a source is its target
    without the fraction.  Null texts have no words; null sources are one source; rows with equal ids follow one another by
    size.  An empty table gives an empty result.
    """
    sized = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return allot(sized, weights, share, max_epochs, seed, digits).withColumnRenamed("_id", id_col)


def allot(sized: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED, digits: int = 3) -> DataFrame:
    """``mix`` for rows (_id, source, size); other columns stay."""
    keyed = sized.withColumn("_key", random_key(F.col("_id"), seed)).withColumn("_range", F.substring("_key", 1, digits))
    ranges = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_range_size"))
    along = Window.partitionBy("source").orderBy("_range")
    ranges = ranges.withColumn("_before", F.sum("_range_size").over(along) - F.col("_range_size"))
    sources = ranges.groupBy("source").agg(F.sum("_range_size").alias("source_size"))
    targets = source_targets(sources, weights, share, max_epochs)
    t = targets.withColumnRenamed("source", "_source")
    placed = ranges.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_range_size", "weight")
    p = placed.withColumnsRenamed({"source": "_source", "_range": "_placed"})
    within = Window.partitionBy("source", "_range").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("_inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = run.join(p, (F.col("_range") == F.col("_placed")) & F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_inner")))
    return joined.select(*sized.columns, "source_size", "target", (epochs * F.col("size") + last).alias("taken"))


def take(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, with the columns of ``df``: a document comes once for each epoch that takes it whole, and the one
    document of a source at which its budget ends comes with its text cut behind the last word taken.  Documents without words
    come once.  Rows that repeat id and text get the share of the first of them each."""
    columns = df.columns
    own, hashed, size, taken, cut_at = groups.fresh(df, "_id", "_h", "_size", "_taken", "_words")
    sized = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("_h"), word_count(F.col(text_col)).alias("size"))
    shares = allot(sized, **options).select(F.col("_id").alias(own), F.col("_h").alias(hashed), F.col("size").alias(size), F.col("taken").alias(taken)).dropDuplicates([own, hashed])
    words = F.col(taken) % F.col(size)
    pieces = F.concat(
        F.array_repeat(F.lit(None).cast("bigint"), (F.col(taken) / F.col(size)).cast("int")),
        F.when(words > 0, F.array(words)).otherwise(F.array().cast("array<bigint>")),
    )
    pieces = F.when(F.col(size) > 0, pieces).otherwise(F.array(F.lit(None).cast("bigint")))
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(hashed))
    rows = df.join(shares, same).withColumn(cut_at, F.explode(pieces))
    cut = F.when(F.col(cut_at).isNull(), F.col(text_col)).otherwise(first_words(F.col(text_col), F.col(cut_at)))
    return rows.withColumn(text_col, cut).select(*columns)


def first_words(text: Column, words: Column) -> Column:
    """A text up to the end of its n-th word."""
    parts = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")
