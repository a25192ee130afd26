"""Keeping embeddings in step with evidence by content hash, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.functions import text
from evidentia.operators import retrieval


def plan_sync(evidence: DataFrame, cache: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, action, content_hash): reused, new, changed or stale, from a full outer join on the id."""
    now = evidence.select(F.col(id_col).alias("id"), text.content_hash(F.coalesce(text_col, F.lit(""))).alias("_now"))
    held = cache.select(F.col(id_col).alias("id"), F.col("content_hash").alias("_held"))
    rows = now.join(held, "id", "full_outer")
    action = F.when(F.col("_now").isNull(), "stale").when(F.col("_held").isNull(), "new").when(F.col("_now") == F.col("_held"), "reused").otherwise("changed")
    return rows.select("id", action.alias("action"), F.coalesce("_now", "_held").alias("content_hash"))


def apply_sync(evidence: DataFrame, cache: DataFrame, id_col: str, text_col: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache after a sync: reused rows as they are, new and changed ones through ``embed``, stale ones gone."""
    plan = plan_sync(evidence, cache, id_col, text_col)
    reused = cache.join(plan.filter("action = 'reused'").select(F.col("id").alias(id_col)), id_col, "left_semi")
    fresh = plan.filter("action in ('new', 'changed')").select(F.col("id").alias(id_col), "content_hash")
    return reused.unionByName(embed(evidence.join(fresh, id_col)).select(*cache.columns))


def plan_index(evidence: DataFrame, index: DataFrame, model: str, dimensions: int | None = None) -> DataFrame:
    """(owner_id, evidence_id, content_hash, action) of a sync of some owners' evidence with the vectors of one model.

    ``evidence`` has (owner_id, evidence_id, text), ``index`` (owner_id, evidence_id, model, dimensions, content_hash).  A row is reused when
    owner, id, hash and, where given, dimensions agree; other evidence is embedded; rows of the same owners and model that no
    evidence stands behind are deleted.  Other owners and models are left alone.  An id that comes twice for an owner, or whose
    content another owner has stored, is an error that names it."""
    now = evidence.select("owner_id", "evidence_id", text.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    counted = now.groupBy("owner_id", "evidence_id").agg(F.max("content_hash").alias("content_hash"), F.count("*").alias("_n"))
    held = index.filter(F.col("model") == model).select("owner_id", "evidence_id", "content_hash", "dimensions")
    foreign = held.select(F.col("owner_id").alias("_other"), "evidence_id", "content_hash").join(counted.select("owner_id", "evidence_id", "content_hash"), ["evidence_id", "content_hash"])
    foreign = foreign.filter("_other != owner_id").select("owner_id", "evidence_id").distinct().withColumn("_foreign", F.lit(True))
    checked = counted.join(foreign, ["owner_id", "evidence_id"], "left")
    said = lambda what: F.raise_error(F.concat(F.lit(what), F.col("evidence_id").cast("string"))).cast("string")
    hash_ = F.when(F.col("_n") > 1, said("evidence ids must be unique: ")).when(F.col("_foreign"), said("evidence id is stored for another owner: ")).otherwise(F.col("content_hash"))
    wanted = checked.select("owner_id", "evidence_id", hash_.alias("content_hash"))
    fits = F.lit(True) if dimensions is None else F.coalesce(F.col("dimensions") == dimensions, F.lit(False))
    same = held.filter(fits).select("owner_id", "evidence_id", "content_hash").withColumn("_held", F.lit(True))
    keep = wanted.join(same, ["owner_id", "evidence_id", "content_hash"], "left")
    keep = keep.select("owner_id", "evidence_id", "content_hash", F.when(F.col("_held"), "reused").otherwise("embedded").alias("action"))
    owners = evidence.select("owner_id").distinct()
    kept = keep.filter("action = 'reused'").select("owner_id", "evidence_id", "content_hash")
    gone = held.select("owner_id", "evidence_id", "content_hash").join(owners, "owner_id", "left_semi").join(kept, ["owner_id", "evidence_id", "content_hash"], "left_anti")
    return keep.unionByName(gone.withColumn("action", F.lit("deleted")))


def apply_index(evidence: DataFrame, index: DataFrame, plan: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index after a plan: what other owners and models hold, reused rows, and new ones through ``embed``.

    ``embed`` gets (owner_id, evidence_id, text, content_hash, model) and adds ``embedding``; an empty or non-finite vector is an error."""
    keys = ["owner_id", "evidence_id", "content_hash"]
    owners = evidence.select("owner_id").distinct()
    own = F.col("model") == model
    others = index.filter(~own).unionByName(index.filter(own).join(owners, "owner_id", "left_anti"))
    reused = index.filter(own).join(plan.filter("action = 'reused'").select(*keys), keys, "left_semi")
    fresh = evidence.select("owner_id", "evidence_id", "text").join(plan.filter("action = 'embedded'").select(*keys), ["owner_id", "evidence_id"])
    vector = retrieval.valid_vector(F.col("embedding"))
    made = embed(fresh.withColumn("model", F.lit(model))).withColumn("embedding", vector).withColumn("dimensions", F.size("embedding"))
    return others.unionByName(reused).unionByName(made.select(*index.columns))


def read_index(spark, path: str, model: str) -> DataFrame:
    """The stored vectors of one model; those of others are left out."""
    return spark.read.parquet(path).filter(F.col("model") == model)


def write_index(index: DataFrame, path: str) -> None:
    """The index by model, so that a reader of one model reads its files alone."""
    index.write.partitionBy("model").mode("overwrite").parquet(path)


def owned_vectors(index: DataFrame, owner: str, model: str, dimensions: int, categories: list[str] | None = None) -> DataFrame:
    """The vectors that one owner may search: of that owner, model and number of dimensions, and of some categories."""
    rows = index.filter((F.col("owner_id") == owner) & (F.col("model") == model) & (F.col("dimensions") == dimensions))
    return rows if categories is None else rows.filter(F.col("category").isin(*categories))


def in_scope(rows: DataFrame, owner: str, evidence_ids: DataFrame) -> DataFrame:
    """Rows of an owner, and rows of anyone with one of some ids: the two scopes that a sync looks at."""
    named = evidence_ids.select("evidence_id").distinct().withColumn("_named", F.lit(True))
    found = rows.join(named, "evidence_id", "left").filter((F.col("owner_id") == owner) | F.col("_named"))
    return found.drop("_named")


def stream_unseen(updates: DataFrame, id_col: str, text_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """A stream of evidence without the versions (id and content hash) that came within ``delay`` before."""
    keyed = updates.withColumn("content_hash", text.content_hash(F.coalesce(text_col, F.lit("")))).withWatermark(time_col, delay)
    return keyed.dropDuplicatesWithinWatermark([id_col, "content_hash"])


def append_json(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run what is there of a stream into a ledger of JSON lines, then stop."""
    return updates.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def usage_by_window(events: DataFrame, time_col: str, key: str, value: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Calls and sums for each key and tumbling window; late rows within ``delay`` still count."""
    rows = events.withWatermark(time_col, delay)
    return rows.groupBy(F.window(time_col, window), key).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))
