"""Keyword, vector and hybrid search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.rank import fuse

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def keyword(texts: DataFrame, query: str, limit: int, key: str = "id", text: str = "raw_text") -> DataFrame:
    """id, score, rank: BM25 over all texts, for a text that holds any word of the query.

    Words are counted in place: no token is exploded, corpus statistics are a one-row aggregate, and nothing but the
    top `limit` rows is shuffled.
    """
    words = list(dict.fromkeys(w.lower() for w in re.findall(r"[^\W_]+", query)))
    empty = texts.select(F.col(key).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    if not words:
        return empty
    low = F.lower(F.col(text))

    def times(word: str) -> Column:
        whole = F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])"))
        return F.when(low.contains(word), whole).otherwise(0)

    counted = texts.where(F.col(text).isNotNull()).select(
        F.col(key).alias("id"), F.regexp_count(F.col(text), F.lit(r"[\p{L}\p{N}]+")).alias("length"), *[times(w).alias(f"tf_{i}") for i, w in enumerate(words)]
    )
    found = counted.agg(F.count("*"), F.avg("length"), *[F.count_if(F.col(f"tf_{i}") > 0) for i in range(len(words))]).first()
    n, mean, df = found[0], found[1] or 1.0, found[2:]
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.greatest(F.log((F.lit(n - df[i]) + 0.5) / (F.lit(df[i]) + 0.5)), F.lit(0.0))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        tf = F.col(f"tf_{i}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    any_word = F.greatest(*[F.col(f"tf_{i}") for i in range(len(words))], F.lit(0)) > 0
    top = counted.where(any_word).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def nearest(vectors: DataFrame, query: Sequence[float], limit: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """id, distance, rank: the vectors at the smallest Euclidean distance; those of another length take no part."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    squares = F.aggregate(F.zip_with(F.col(vector), wanted, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    near = vectors.where(F.size(vector) == len(query)).select(F.col(key).alias("id"), F.sqrt(squares).alias("distance"))
    top = near.where(~F.isnan("distance")).orderBy("distance", "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def hybrid(texts: DataFrame, vectors: DataFrame, query: str, embedded: Sequence[float], limit: int = 20, pool: int = 5) -> DataFrame:
    """id, score: the keyword and the vector list, each of limit * pool rows, fused by reciprocal ranks."""
    lists = [keyword(texts, query, limit * pool).select("id", "rank"), nearest(vectors, embedded, limit * pool).select("id", "rank")]
    return fuse(lists, limit)


def embed(query: str, buckets: int = 64) -> list[float]:
    """The hash embedding of a query, as `functions.vectors.hash_embedding` makes it."""
    counts = [0.0] * buckets
    for word in re.findall(r"[^\W_]+", query.lower()):
        h = 0x811C9DC5
        for byte in word.encode():
            h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
        counts[h % buckets] += 1
    length = sum(c * c for c in counts) ** 0.5
    return [c / length for c in counts] if length else counts
