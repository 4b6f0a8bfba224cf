"""Embedders of comment texts, and vectors kept by text and model."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.vectors import hash_embedding


class Embedder(Protocol):
    """Anything that turns distinct texts (content_hash, raw_text) into content_hash, vector."""

    model_version: str
    dimensions: int

    def embed(self, texts: DataFrame) -> DataFrame: ...


class HashEmbedder:
    """Counts of words in hash buckets, scaled to unit length: needs no model and gives the same everywhere."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions
        self.model_version = f"det{dimensions}/1"

    def embed(self, texts: DataFrame) -> DataFrame:
        return hash_embedding(texts, "content_hash", "raw_text", self.dimensions)


def missing_vectors(comments: DataFrame, cache: DataFrame, model_version: str) -> DataFrame:
    """content_hash, raw_text of texts without a vector of the model, each once."""
    texts = comments.where(F.col("raw_text").isNotNull()).groupBy("content_hash").agg(F.min("raw_text").alias("raw_text"))
    return texts.join(cache.where(F.col("model_version") == model_version).select("content_hash"), "content_hash", "left_anti")


def with_vectors(comments: DataFrame, cache: DataFrame, embedder: Embedder) -> DataFrame:
    """content_hash, vector of all texts of `comments`: cached vectors, and new ones for what is missing."""
    kept = cache.where(F.col("model_version") == embedder.model_version).groupBy("content_hash").agg(F.first("vector").alias("vector"))
    known = kept.select("content_hash", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    wanted = known.join(comments.select("content_hash"), "content_hash", "left_semi")
    return wanted.unionByName(embedder.embed(missing_vectors(comments, cache, embedder.model_version)))
