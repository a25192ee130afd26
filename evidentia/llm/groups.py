"""Totals of groups given back to every row, when one group may hold a third of all rows."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def salt(*cols: Column, salts: int = SALTS) -> Column:
    """One of ``salts`` numbers, the same for the same values, so that a recomputed task deals its rows alike."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def uniform(*cols: Column) -> Column:
    """A number of [0, 1) by the hash of some columns, in steps of 2**-53: fine enough for the rates of samples of any table."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def partial_then_total(keyed: DataFrame, keys: list[str], partial: dict[str, Column], total: dict[str, Column]) -> DataFrame:
    """(keys, ``_salt``, totals): one row for each key and salt, so that a join on both meets no hot key.

    ``partial`` aggregates the rows of a key and salt, ``total`` the partial rows of a key.
    """
    parts = keyed.groupBy(*keys, "_salt").agg(*(c.alias(n) for n, c in partial.items()))
    totals = parts.groupBy(*keys).agg(*(c.alias(n) for n, c in total.items()), F.collect_list("_salt").alias("_salts"))
    return totals.withColumn("_salt", F.explode("_salts")).drop("_salts")


def sha256(text: Column) -> Column:
    """SHA-256 of a text in UTF-8, in 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def base32_sha1(data: Column) -> Column:
    """SHA-1 of bytes in upper-case base32; null counts as empty.  Each 20 of the 160 bits are four letters."""
    letters, digest = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.sha1(F.coalesce(data, F.lit(b"")))
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    quads = F.transform(parts, lambda n: F.concat(*(F.substring(letters, F.shiftright(n, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4))))
    return F.array_join(quads, "")


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is; texts of ASCII alone take the faster function, which equals it there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until ``df`` has no column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
