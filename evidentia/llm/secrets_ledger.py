"""Secret scans with an incremental ledger of blobs.

A version of a file (here a row) is a blob, addressed by the SHA-256 of its text, at a path (the row's id).  The ledger is a
table of (blob, rules, spans): which blob was scanned under which version of the rules, and what was found.  A scan

1. addresses every row and keeps one text for each blob (Spark drops copies before the shuffle as well as after it);
2. takes out the blobs that the ledger holds under the present rules (left anti join);
3. scans what is left, once for each blob, and adds it to the ledger;
4. joins findings back to all paths of a blob, salted, so that a blob with a third of all paths is no hot key.

Null texts are the empty blob.  Very long texts are scanned whole, and runs in them once.  Positions are code points, ends
exclusive; of findings that start together kinds are listed in the order of ``RULES``.  Rows that repeat, share an id or have
none get the findings of their text each.  An empty table gives no rows and a ledger that is as it was.  Extra columns of the
input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import groups, store

#: kind -> (pattern, group whose length counts, least length); base kinds first, in the order in which ties are listed.
#: Patterns that begin with a run of letters start where the run does, so that a very long run is scanned once; a group
#: ``found`` is the finding within it.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(?P<found>eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", 0, 1),
    "bearer": (r"(?ai)bearer\x20+([A-Za-z0-9+/_.=-]+)", 1, 20),
    "url_login": (r"(?<![a-z])[a-z]+://[^\s/:@]+:[^\s/:@]+@", 0, 1),
}
BASE = ("assign", "access", "hex")
#: A text without any of a kind's words (in lower case) cannot match it, and its pattern isn't run.
NEEDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "pem": ("-----begin ",),
    "jwt": ("eyj",),
    "bearer": ("bearer",),
    "url_login": ("://",),
}
RULES_VERSION = hashlib.sha256(repr(sorted(RULES.items())).encode()).hexdigest()[:16]
COMPILED = {kind: re.compile(pattern) for kind, (pattern, _, _) in RULES.items()}
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rules", T.StringType()), T.StructField("spans", SPANS)])


def spans_of(text: str) -> list[dict]:
    """All spans by start, then kind in the order of RULES, then end."""
    low, found = text.lower() if text.isascii() else text.translate(_LOWER), []
    for rank, (kind, (_, group, least)) in enumerate(RULES.items()):
        if kind in NEEDS and not any(word in low for word in NEEDS[kind]):
            continue
        for m in COMPILED[kind].finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start("found" if "found" in m.re.groupindex else 0), rank, m.end(), kind))
    return [{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(found)]


_LOWER = {c: c + 32 for c in range(65, 91)}


def address(text: Column) -> Column:
    return groups.sha256(text)


@F.arrow_udf(SPANS)
def scan_text(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([spans_of(x.as_py() or "") for x in texts], kind)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def unseen(df: DataFrame, ledger: DataFrame, text_col: str = "text") -> DataFrame:
    """(blob, text): one text for each blob that the ledger does not hold under the present rules."""
    blobs = df.select(address(F.col(text_col)).alias("blob"), F.col(text_col).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    return blobs.join(ledger.filter(F.col("rules") == RULES_VERSION), "blob", "left_anti")


def scan(df: DataFrame, ledger: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows by which the ledger grows."""
    return unseen(df, ledger, text_col).select("blob", F.lit(RULES_VERSION).alias("rules"), scan_text(F.col("text")).alias("spans"))


def findings(df: DataFrame, ledger: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, blob, spans) for every row of ``df``, from a ledger that holds all its blobs; no findings are an empty array."""
    paths = df.select(F.col(id_col).alias("_id"), address(F.col(text_col)).alias("blob")).withColumn("_salt", groups.salt(F.col("_id")))
    paths = store.table(paths, "paths")
    salts = paths.select("blob", "_salt").distinct()
    found = ledger.filter((F.col("rules") == RULES_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    salted = salts.join(found, "blob")
    empty = F.array().cast(SPANS)
    known = paths.join(salted, ["blob", "_salt"], "left").select(F.col("_id").alias(id_col), "blob", F.coalesce("spans", empty).alias("spans"))
    return known


def scan_history(df: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(findings for every row, the grown ledger), the new part of which is written once to the shared folder."""
    store.bound_batches(df.sparkSession)
    held = empty_ledger(df.sparkSession) if ledger is None else ledger
    grown = held.unionByName(store.table(scan(df, held, text_col), "ledger"))
    return findings(df, grown, text_col, id_col), grown
