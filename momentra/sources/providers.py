"""Seams for models and services: their outputs enter plans as columns or tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    """Encodes batches of texts or image bytes to vectors."""

    def encode_text(self, texts: list[str]) -> list[list[float]]: ...

    def encode_image(self, images: list[bytes]) -> list[list[float]]: ...


class RerankProvider(Protocol):
    """Scores items against a query."""

    def score(self, query: str, items: list[str]) -> list[float]: ...


_REGISTRY: dict[str, Callable[[], object]] = {}


def register(name: str, make: Callable[[], object]) -> None:
    _REGISTRY[name] = make


def known() -> list[str]:
    return sorted(_REGISTRY)


def encode(df: DataFrame, make: Callable[[], EmbeddingProvider], text: str = "text", out: str = "v") -> DataFrame:
    """Adds vectors; each worker makes the model once and feeds it Arrow batches."""
    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(**{out: model.encode_text(b[text].fillna("").tolist())})

    return df.mapInPandas(run, f"{schema},{out}:array<double>")


def rerank_scores(df: DataFrame, make: Callable[[], RerankProvider], query: str, item: str) -> DataFrame:
    """Adds ``cross`` scores of (query, item) pairs."""
    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            scores = pd.Series(0.0, index=b.index)
            for q, part in b.groupby(query):
                scores.loc[part.index] = model.score(q, part[item].tolist())
            yield b.assign(cross=scores)

    return df.mapInPandas(run, f"{schema},cross:double")


def difference_hash(df: DataFrame, pixels: str = "gray") -> DataFrame:
    """64-bit difference hash of 9 x 8 gray images (row-major ``array<int>``), JVM-side."""
    bits = [F.when(F.get(pixels, F.lit(9 * r + c + 1)) > F.get(pixels, F.lit(9 * r + c)), F.lit(1)).otherwise(F.lit(0)) for r in range(8) for c in range(8)]
    value = F.lit(0).cast("bigint")
    for b in bits:
        value = F.shiftleft(value, 1).bitwiseOR(b.cast("bigint"))
    return df.withColumn("dhash", value)


def video_frames(paths: DataFrame, decode: Callable[[str, int], Iterator[tuple[int, bytes]]], stride: int) -> DataFrame:
    """Decoded frames ``path, frame_idx, image`` through a decoder that the caller brings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                for i, image in decode(p, stride):
                    yield pd.DataFrame({"path": [p], "frame_idx": [i], "image": [image]})

    return paths.select("path").mapInPandas(run, "path string, frame_idx long, image binary")
