"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; ``run`` writes each result to the
shared folder and reads it again for the next one.  All stages but the last return the columns of ``documents``, and extra
columns, whatever their names, if the table has them.

Odd rows, stage by stage.  Quality: null and empty texts are scored as empty, very long ones whole, rows that repeat alike.  Exact
dedup: null counts as empty; of rows that repeat id and text one stays; a row without an id stays only where none of its equals
has one.  Near-dedup: texts without words are linked with nothing; rows without an id stay.  Mixing: texts without words stay once.
SentencePiece: null is encoded as the empty text.  An empty table passes all stages as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import cuckoo, groups, mixing, neardup, quality_rff, sentencepiece_codec, store
from evidentia.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
LEAST_QUALITY = 0.7
#: Ids of 8 bytes.
LABELS_SENT = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by the labels table, scores at ``LEAST_QUALITY`` or more.

    Up to ``LABELS_SENT`` ids of labels travel to the tasks, so that only labelled documents are measured to teach; beyond, all
    documents are.  Either way texts are not moved, and the model is the same."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    taught = docs
    if labels.count() <= LABELS_SENT:
        (own,) = groups.fresh(docs, "_id")
        ids = labels.select(F.col("doc_id").cast("bigint").alias(own)).distinct()
        taught = docs.join(F.broadcast(ids), F.col("doc_id") == F.col(own), "left_semi")
    model = quality_rff.fit(store.table(quality_rff.measure(taught), "statistics"), labels)
    return docs.filter(quality_rff.text_scorer(model)("text") >= LEAST_QUALITY)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; of rows that repeat id and text one.

    The index says which ids stay.  Joining and dropping repeats have one key, so texts are moved once."""
    names = groups.fresh(docs, "_key", "_digest")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(names[0])
    kept = cuckoo.deduplicate(docs).filter("kept").select(key, F.col("digest").alias(names[1])).distinct()
    rows = docs.select("*", key, cuckoo.digest(F.col("text")).alias(names[1])).join(kept, names, "left_semi")
    return rows.dropDuplicates(names).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    (own,) = groups.fresh(docs, "_id")
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(own))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a document comes as often as the mix takes it, cut where a budget ends."""
    mixed = mixing.take(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct("doc_id", "lang", "source", F.sha2(text.cast("binary"), 256).alias("sha256")).alias("row"), text.alias("text"))
    coded = sentencepiece_codec.encode_documents(keyed, vocabulary("piece_bpe_32k.model"), "text", "row")
    same = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("row.sha256")
    return coded.select("row.doc_id", "row.lang", "row.source", F.size("ids").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLE_SQL = None
