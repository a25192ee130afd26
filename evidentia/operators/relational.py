"""Scans, searches, greatest-per-group joins, identity deduplication and reference checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, filters: dict | None = None, order: list | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Equality filters from a dict (an unknown field is an error), then a stable order and a page of it."""
    for name in filters or {}:
        if name not in df.columns:
            raise ValueError(f"unknown field: {name}")
    for name, value in (filters or {}).items():
        df = df.filter(F.col(name).isNull() if value is None else F.col(name) == value)
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def search(df: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows where any field, as text, contains the query in any case; % and _ keep their meaning."""
    if not fields:
        raise ValueError("a search needs fields")
    return df.filter(reduce(or_, (as_text(df, f).ilike(f"%{query}%") for f in fields)))


def as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.to_json(name) if kind in ("array", "map", "struct") else F.col(name).cast("string")


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """All rows with the greatest ``by`` of their keys, ties included."""
    top = df.groupBy(*keys).agg(F.max(by).alias(by))
    return df.join(top, [*keys, by])


def next_revision(df: DataFrame, key: str, by: str) -> DataFrame:
    return df.groupBy(key).agg((F.coalesce(F.max(by), F.lit(0)) + 1).cast("bigint").alias("next_revision"))


def newest_identity(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row for each identity: the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def orphans(df: DataFrame, key: str, references: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows that no reference table names."""
    for table, column in references:
        df = df.join(table.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return df


def union_of_ids(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct non-null ids from several tables, as text order wants them."""
    ids = [t.select(F.col(c).cast("string").alias("id")) for t, c in parts]
    return reduce(DataFrame.unionByName, ids).filter("id is not null").distinct()


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each row and each rule that does not hold; a null condition counts as broken."""
    broken = F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))
    return df.select(*key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def replace_section(existing: DataFrame, incoming: DataFrame, owner: str) -> DataFrame:
    """Children of the owners that ``incoming`` names are replaced as a whole; other owners keep theirs."""
    owners = incoming.select(owner).distinct()
    return existing.join(owners, owner, "left_anti").unionByName(incoming)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows win over existing ones with the same keys."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def aggregate_root(root: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Each root row with an array of structs for each child table, empty where it has none."""
    for name, child in children.items():
        fields = [c for c in child.columns if c != key]
        grouped = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        root = root.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return root


def owned_aggregate(root: DataFrame, key: str, owner: str, value, children: dict[str, DataFrame]) -> DataFrame:
    """``aggregate_root`` for the rows of one owner: others are filtered before children are grouped."""
    own = root.filter(F.col(owner) == value)
    keys = own.select(key).distinct()
    return aggregate_root(own, key, {name: child.join(keys, key, "left_semi") for name, child in children.items()})


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(the rows after an update, one row with the number of rows it touched)."""
    hit = F.coalesce(condition, F.lit(False))
    after = df.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()})
    return after, df.agg(F.count_if(hit).alias("updated"))


def delete_cascade(tables: dict[str, DataFrame], key: str, doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without rows of the doomed keys, (position, table, deleted) in the given order: children before parents)."""
    keys = doomed.select(key).distinct()
    left = {name: df.join(keys, key, "left_anti") for name, df in tables.items()}
    counts = [df.join(keys, key, "left_semi").agg(F.lit(i).alias("position"), F.lit(name).alias("table"), F.count("*").alias("deleted")) for i, (name, df) in enumerate(tables.items())]
    return left, reduce(DataFrame.unionByName, counts)


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def by_title(rows: DataFrame, decisions: DataFrame, title: str = "title") -> DataFrame:
    """Rows with the decision on their title in any case; those called unsupported are dropped, those without one stay."""
    ruled = decisions.select(F.lower(title).alias("_t"), *[c for c in decisions.columns if c != title])
    joined = rows.withColumn("_t", F.lower(title)).join(ruled, "_t", "left").drop("_t")
    return joined.filter(F.coalesce(F.col("decision") != "unsupported", F.lit(True)))
