"""Held-out passages in a corpus, found by winnowing.

Every text is a sequence of words (maximal runs of letters and digits, without case). Of the hashes of its k-word
grams, winnowing keeps the smallest of each window of w neighbours (the last one of equals). Two texts that share
k + w - 1 consecutive words share a whole window and so keep the same gram of it: no such span is missed. The kept
grams of corpus and items are joined and each hit is extended, word by word, as far as the span can reach.

The corpus is read once. A bit table of fixed size over the items' grams (at most `filter_bits` bits, merged by
Spark) lets each task drop grams that no item holds before anything is shuffled; the join decides, so a full bit table
costs time and never a hit. The items' grams are broadcast only if they were counted to be few.

Defined results: null, empty and shorter texts have no spans; rows without id give none; a pair comes out once,
however often rows repeat; texts are read whole; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.words import WordHashes, mix, slices

SPAN = 12
GRAM = 8
FILTER_BITS = 1 << 23
#: Item grams up to which they are broadcast (some 40 MB); beyond, both sides are shuffled by gram.
BROADCAST_GRAMS = 200_000
WORDS_AT_ONCE = 400_000

_GRAMS = "owner BIGINT, gram BIGINT, around ARRAY<BIGINT>"


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w, total = words.astype(np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return mix(total)


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions kept: of each window of w neighbours the smallest, the last one of equals."""
    if len(grams) < w:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
    return np.unique(np.arange(len(windows)) + w - 1 - windows.argmin(axis=1))


def _kept(batch: pd.DataFrame, hashes: WordHashes, span: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """owner, gram and the words around it, of all kept grams of a batch."""
    reach = span - k
    texts = batch["text"].tolist()
    owners = batch["owner"].to_numpy()
    for a, b in slices([len(t) // 6 if t else 0 for t in texts], WORDS_AT_ONCE):
        parts = [hashes.of(t) for t in texts[a:b]]
        lengths = np.array([len(p) for p in parts], np.int64)
        words = np.concatenate(parts)
        if len(words) < span:
            continue
        grams = gram_hashes(words, k)
        owner_of = np.repeat(np.arange(a, b), lengths)
        left = np.concatenate([[0], np.cumsum(lengths)[:-1]]).repeat(lengths)
        right = left + lengths.repeat(lengths)
        # Windows are taken over the batch as a whole; those that cross the border of two texts don't count.
        w = reach + 1
        start = np.arange(len(words) - span + 1)
        start = start[start + span <= right[start]]
        if not len(start):
            continue
        windows = np.lib.stride_tricks.sliding_window_view(grams, w)[start][:, ::-1]
        at = np.unique(start + w - 1 - windows.argmin(axis=1))
        yield owners[owner_of[at]], grams[at].view(np.int64), at, words, left[at], right[at]


def _around(at: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int, k: int) -> np.ndarray:
    """Words from `reach` before the gram to `reach` after it; 0 beyond the text."""
    where = at[:, None] + np.arange(-reach, k + reach)
    inside = (where >= left[:, None]) & (where < right[:, None])
    return np.where(inside, words[np.clip(where, 0, len(words) - 1)], 0)


def fingerprints(df: DataFrame, owner: str, text: str, span: int = SPAN, k: int = GRAM, bits: object = None) -> DataFrame:
    """owner, gram, around: the kept grams of each text. bits: a broadcast bit table; grams outside it are dropped."""
    reach = span - k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        table = bits.value if bits is not None else None
        for batch in batches:
            for owners, grams, at, words, left, right in _kept(batch, hashes, span, k):
                if table is not None:
                    slot = grams & (len(table) * 8 - 1)
                    held = (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
                    held = held.astype(bool)
                    owners, grams, at, left, right = owners[held], grams[held], at[held], left[held], right[held]
                if len(at):
                    around = _around(at, words, left, right, reach, k)
                    yield pd.DataFrame({"owner": owners, "gram": grams, "around": list(around)})

    rows = df.where(F.col(owner).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(owner).cast("bigint").alias("owner"), F.col(text).alias("text")).mapInPandas(run, _GRAMS)


def _bit_table(grams: DataFrame, filter_bits: int) -> np.ndarray:
    """The grams as a table of `filter_bits` bits (a power of two); merged by Spark, so the driver gets that much at most."""
    found = (
        grams.select(F.col("gram").bitwiseAND(filter_bits - 1).alias("slot"))
        .groupBy(F.expr("shiftright(slot, 3)").alias("byte"))
        .agg(F.expr("bit_or(shiftleft(1, cast(slot & 7 as int)))").alias("bits"))
        .toPandas()
    )
    table = np.zeros(filter_bits // 8, np.uint8)
    table[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint8)
    return table


def leaks(
    items: DataFrame,
    documents: DataFrame,
    item_id: str = "item_id",
    doc_id: str = "doc_id",
    text: str = "text",
    span: int = SPAN,
    k: int = GRAM,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """item_id, doc_id of every document that holds `span` consecutive words of an item."""
    reach = span - k
    spark = documents.sparkSession
    held = fingerprints(items, item_id, text, span, k).dropDuplicates()
    table = spark.sparkContext.broadcast(_bit_table(held, filter_bits))
    few = held.count() <= BROADCAST_GRAMS
    item_grams = held.select(F.col("owner").alias("item_id"), "gram", F.col("around").alias("item_around"))
    found = fingerprints(documents, doc_id, text, span, k, table).withColumnRenamed("owner", "doc_id")
    hits = found.join(F.broadcast(item_grams) if few else item_grams, "gram")

    def same(i: int) -> str:
        return f"around[{i}] = item_around[{i}] AND around[{i}] <> 0"

    # How far the hit extends: words equal to the right of the gram, and to its left.
    def run(places: list[int]) -> str:
        cases = " ".join(f"WHEN NOT ({same(p)}) THEN {n}" for n, p in enumerate(places))
        return f"CASE {cases} ELSE {len(places)} END"

    whole = " AND ".join(same(i) for i in range(reach, reach + k))
    left, right = run(list(range(reach - 1, -1, -1))), run(list(range(reach + k, 2 * reach + k)))
    return hits.where(F.expr(f"{whole} AND {left} + {right} >= {reach}")).select("item_id", "doc_id").distinct()
