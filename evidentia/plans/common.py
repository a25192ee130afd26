"""Helpers of the named queries: tables, inline fixtures for both engines, and the token rule in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], name: str, columns: str) -> str:
    """The rows of a fixture as an SQL table expression."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(literal, v)) + "]"
        return str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS {name}({columns})"


def tokens_sql(column: str) -> str:
    """DuckDB expression for the retrieval tokens of a text column."""
    low = f"replace(lower(coalesce({column}, '')), 'ß', 'ss')"
    for old, new in text.RETRIEVAL_REPLACEMENTS:
        low = f"replace({low}, '{old}', '{new}')"
    tokens = f"list_filter(list_transform(regexp_extract_all({low}, '[a-z0-9+#.]+'), lambda t: trim(t, '.')), lambda t: t <> '')"
    cases = " ".join(f"WHEN t = '{a}' THEN [t, '{b}']" for a, b in text.TOKEN_ALIASES.items())
    return f"flatten(list_transform({tokens}, lambda t: CASE {cases} ELSE [t] END))"


def scorecard_text_sql(column: str) -> str:
    low = f"lower({column})"
    for old, new in text.SCORECARD_REPLACEMENTS:
        low = f"replace({low}, '{old}', '{new}')"
    return f"trim(regexp_replace({low}, '[^a-z0-9+#.]+', ' ', 'g'))"


def percent_sql(part: str, whole: str, empty: str) -> str:
    return f"coalesce(CAST(round(CAST(CAST({part} AS DECIMAL(20,4)) * 100 / nullif({whole}, 0) AS DECIMAL(28,12)), 2) AS DOUBLE), {empty}::DOUBLE)"


def unit_sql(value: str) -> str:
    return f"CAST(round(CAST(least(greatest({value}, 0::DOUBLE), 1::DOUBLE) AS DECIMAL(20,15)), 4) AS DOUBLE)"
