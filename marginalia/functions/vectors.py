"""Vector functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import FNV_MASK, FNV_OFFSET, FNV_PRIME, tokens

BUCKETS = 64
#: Distinct words remembered by a task before its memory is emptied.
MEMORY = 500_000


def dot(a: Column, b: Column) -> Column:
    """The sum of products over the common length."""
    products = F.filter(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x.isNotNull())
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """Cosine similarity; 0 where a norm is 0. strict: also 0 where the lengths differ."""
    scale = norm(a) * norm(b)
    usable = (scale > 0) & ((F.size(a) == F.size(b)) if strict else F.lit(True))
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """`a` scaled to length 1; unchanged where its norm is 0."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def hash_embedding(df: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """key, vector: counts of each text's words in hash buckets, scaled to unit length; one row for each key.

    Words are split in the JVM; each task hashes a word once and remembers it, so nothing is shuffled but repeated keys.
    Texts without words, and null texts, get a vector of zeros.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            words = batch["words"].tolist()
            out = np.zeros((len(words), buckets))
            for i, ws in enumerate(words):
                for word in () if ws is None else ws:
                    b = known.get(word)
                    if b is None:
                        if len(known) > MEMORY:
                            known.clear()
                        b = known[word] = fnv1a_of(word) % buckets
                    out[i, b] += 1
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            yield pd.DataFrame({key: batch[key], "vector": list(out / np.where(norm > 0, norm, 1))})

    rows = df.select(key, tokens(F.col(text)).alias("words")).dropDuplicates([key])
    return rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, vector ARRAY<DOUBLE>")


def fnv1a_of(word: str) -> int:
    """32-bit FNV-1a of a word's UTF-8 bytes."""
    h = FNV_OFFSET
    for byte in word.encode("utf-8", "surrogatepass"):
        h = (h ^ byte) * FNV_PRIME & FNV_MASK
    return h
