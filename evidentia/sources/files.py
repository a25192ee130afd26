"""File sources and sinks: run ledgers, evaluation fixtures, document text and file metadata."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "id string, category string, query string, relevant array<string>, distractors array<string>, expected_status string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file {"cases": [...]}; a case without id, query or a known category is an error."""
    cases = spark.read.schema(f"cases array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in CASE.split(', ')))}>>").json(path, multiLine=True)
    rows = cases.select(F.explode("cases").alias("c")).select("c.*")
    good = (F.trim("id") != "") & (F.trim("query") != "") & F.col("category").isin("exact", "paraphrase", "near_miss", "unsupported")
    return rows.withColumn("id", F.when(good, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("bad case: "), F.to_json(F.struct("*"))))))


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def docx_text(content: bytes) -> str:
    """Paragraphs, then table rows with their cells joined by " | "; an error if it is no DOCX file."""
    if content[:2] != b"PK":
        raise ValueError("not a DOCX file")
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    inside = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = [inside(p) for p in body.findall(f"{_W}p")]
    out += [" | ".join(inside(c) for c in row.findall(f"{_W}tc")) for table in body.findall(f"{_W}tbl") for row in table.findall(f"{_W}tr")]
    return "\n".join(x for x in out if x.strip())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of DOCX files; one file in memory at a time."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [docx_text(bytes(c)) for c in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, "path string, text string")


def write_markdown(df: DataFrame, path: str) -> None:
    """Rows (title, sections array<struct<heading, bullets>>) as one Markdown document each."""
    section = lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n"), F.array_join(F.transform(s["bullets"], lambda b: F.concat(F.lit("- "), b)), "\n"))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), F.array_join(F.transform("sections", section), "\n\n"))
    df.select(body.alias("value")).write.text(path, lineSep="\n\n")


def write_report(results: DataFrame, path: str, columns: list[str], title: str) -> None:
    """An evaluation's results as JSON rows under ``path``/json and, for the few columns of its summary, as a Markdown table under ``path``/markdown."""
    results.write.mode("overwrite").json(f"{path}/json")
    cells = lambda row: F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in row)), " | "), F.lit(" |"))
    head = [f"# {title}", "", f"| {' | '.join(columns)} |", f"|{'|'.join('-' for _ in columns)}|"]
    lines = results.sparkSession.createDataFrame([(0, i, line) for i, line in enumerate(head)], "part int, i bigint, value string")
    rows = results.select(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("i"), cells([F.col(c) for c in columns]).alias("value"))
    lines.unionByName(rows).orderBy("part", "i", "value").select("value").write.mode("overwrite").text(f"{path}/markdown")
