"""Vectors from an embedding service, called in batches from the tasks that hold the texts.

The client is injected: a function that each task calls once for an object with ``embed(texts)``, which returns a ``Response``.  A
response may come in any order; vectors are put back by their index.  Wrong counts, missing indexes, other dimensions and
vectors that are empty, not numeric or not finite are errors.  A batch that fails is sent again, alone, up to ``attempts`` times;
rows before it in the task are not.  Secrets never reach an error's text.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Item:
    index: int
    embedding: Sequence[float]


@dataclass(frozen=True)
class Response:
    items: Sequence[Item]
    prompt_tokens: int = 0


class Client(Protocol):
    def embed(self, texts: list[str]) -> Response: ...


class EmbeddingError(RuntimeError):
    """A service that failed or answered wrongly."""


def ordered_vectors(response: Response, expected: int, dimensions: int | None) -> list[list[float]]:
    """The vectors of a response in the order of its texts."""
    if len(response.items) != expected:
        raise EmbeddingError(f"{len(response.items)} vectors for {expected} texts")
    try:
        ordered = sorted(response.items, key=lambda item: item.index)
    except (AttributeError, TypeError):
        raise EmbeddingError("vectors without indexes") from None
    if [item.index for item in ordered] != list(range(expected)):
        raise EmbeddingError("not every text's index is there")
    return [checked(item.embedding, dimensions) for item in ordered]


def checked(values: Sequence[float], dimensions: int | None) -> list[float]:
    try:
        numbers = [float(x) for x in values]
    except (TypeError, ValueError):
        raise EmbeddingError("a vector that is not numeric") from None
    if not numbers:
        raise EmbeddingError("an empty vector")
    if not all(map(math.isfinite, numbers)):
        raise EmbeddingError("a vector that is not finite")
    if dimensions is not None and len(numbers) != dimensions:
        raise EmbeddingError(f"{len(numbers)} dimensions, expected {dimensions}")
    return numbers


def redacted(message: str, secrets: Sequence[str]) -> str:
    for secret in filter(None, secrets):
        message = message.replace(secret, "[redacted]")
    return message


@dataclass(frozen=True)
class Embedder:
    """Adds ``embedding`` (array of doubles) and ``usage`` (struct of requests and prompt_tokens) to rows with a text column.

    ``usage`` stands on the first row of each accepted batch and is null on others, so its sums tell what the rows cost.  ``dimensions``
    fixes the length of vectors; without it the first vector of a task does.  Batches hold at most ``batch_rows`` texts and
    ``batch_chars`` characters, but one text at least; null texts are empty ones.  Usable as ``embed`` of ``sync.apply_index``."""

    connect: Callable[[], Client]
    text_col: str = "text"
    dimensions: int | None = None
    batch_rows: int = 64
    batch_chars: int = 200_000
    attempts: int = 3
    pause: float = 0.5
    secrets: tuple[str, ...] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        numbered = df.withColumn("_text", F.coalesce(self.text_col, F.lit("")))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return numbered.mapInArrow(self._embedded, f"{fields}, embedding array<double>, usage struct<requests: bigint, prompt_tokens: bigint>")

    def _embedded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, dimensions = None, self.dimensions
        for batch in batches:
            texts, rest = batch.column("_text").to_pylist(), batch.drop_columns(["_text"])
            vectors, usage = [], []
            for begin, end in self._cuts(texts):
                client = client or self.connect()
                made, spent = self._call(client, texts[begin:end], dimensions)
                dimensions = len(made[0])
                vectors += made
                usage += [spent] + [None] * (end - begin - 1)
            columns = [*rest.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array(usage, pa.struct([("requests", pa.int64()), ("prompt_tokens", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, "embedding", "usage"])

    def _cuts(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        begin, chars = 0, 0
        for at, text in enumerate(texts):
            if at > begin and (at - begin >= self.batch_rows or chars + len(text) > self.batch_chars):
                yield begin, at
                begin, chars = at, 0
            chars += len(text)
        if begin < len(texts):
            yield begin, len(texts)

    def _call(self, client: Client, texts: list[str], dimensions: int | None) -> tuple[list[list[float]], dict]:
        for attempt in range(1, self.attempts + 1):
            try:
                response = client.embed(texts)
                found = ordered_vectors(response, len(texts), dimensions)
                for vector in found:
                    checked(vector, len(found[0]))
                return found, {"requests": attempt, "prompt_tokens": int(response.prompt_tokens or 0)}
            except Exception as error:
                if attempt == self.attempts:
                    detail = redacted(f"{type(error).__name__}: {error}", self.secrets)
                    raise EmbeddingError(f"a batch of {len(texts)} texts failed {attempt} times: {detail}") from None
                time.sleep(self.pause * 2 ** (attempt - 1))
        raise AssertionError("attempts must be 1 or more")
