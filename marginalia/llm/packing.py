"""Texts packed into containers of a fixed number of tokens, next to texts they share words with.

Texts are sized by a public tokenizer. A sharded BM25 index over the texts' words answers, for each seed text, which
unused texts are most like it, by all its words that another text of the shard has; these fill the seed's container
greedily, and what room is left goes to the largest unused texts that fit. Only a text above the capacity is split: into full containers and a rest that is packed like
any other text.

Document frequencies and the mean length are taken over all texts (words are counted in FREQUENCY_BUCKETS buckets, so
the table that travels has a fixed size). Shards are ranges of the texts sorted by their most telling word, cut by
Spark to SHARD texts each, so that a word or source that a third of the texts share is spread over many shards and no
task holds more than a shard, which bounds what a seed can retrieve. The vocabulary travels as a file of the job. Texts are read once; their sizes and words are kept in the checkpoint folder.

Defined results: null and empty texts need no room and get no container; rows without id give none; a row repeated
with the same id is packed as often as it stands there; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.words import WORD, WordHashes
from marginalia.plans.lineage import cut

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FREQUENCY_BUCKETS = 1 << 18
SHARD = 2000
K1, B = 1.2, 0.75

_SIZED = "doc_id BIGINT, tokens INT, words BINARY, times BINARY, n_words INT"
PACKED = "container STRING, doc_id BIGINT, piece INT, first_token INT, tokens INT"


def encoder(vocabulary: str) -> object:
    """The public tokenizer, from its vocabulary file."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, and the words (as buckets) with their counts."""

    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        hashes = WordHashes()
        for batch in batches:
            sizes, words, times, totals = [], [], [], []
            for raw in batch["text"]:
                sizes.append(len(encode(raw)))
                found = WORD.findall(raw.lower())
                bucket = np.fromiter(map(hashes.__getitem__, found), np.int64, len(found)) & (FREQUENCY_BUCKETS - 1)
                word, count = np.unique(bucket, return_counts=True)
                words.append(word.astype(np.int32).tobytes())
                times.append(count.astype(np.int32).tobytes())
                totals.append(len(found))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": sizes, "words": words, "times": times, "n_words": totals})

    rows = documents.where(F.col(doc_id).isNotNull() & (F.length(text) > 0))
    return rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, _SIZED)


def frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts the words of each bucket stand; FREQUENCY_BUCKETS numbers at most reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(FREQUENCY_BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch["words"]), np.int32), minlength=FREQUENCY_BUCKETS)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": n[some]})

    found = texts.select("words").mapInPandas(run, "bucket INT, n BIGINT").groupBy("bucket").sum("n").toPandas()
    out = np.zeros(FREQUENCY_BUCKETS, np.int64)
    out[found["bucket"]] = found["sum(n)"]
    return out


def telling(frequency: np.ndarray, n: int) -> np.ndarray:
    """BM25's weight of each bucket's words."""
    return np.log1p((n - frequency + 0.5) / (frequency + 0.5))


def _anchored(texts: DataFrame, weight: object) -> DataFrame:
    """Texts with the bucket of their most telling word among those that other texts share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, shared = weight.value
        for batch in batches:
            anchors = []
            for words in batch["words"]:
                w = np.frombuffer(words, np.int32)
                held = w[shared[w]]
                anchors.append(int(held[idf[held].argmax()]) if len(held) else -1)
            yield batch.assign(anchor=np.array(anchors, np.int32))

    return texts.mapInPandas(run, _SIZED + ", anchor INT")


class _Shard:
    """The BM25 index of one shard, and which of its items are still unused."""

    def __init__(self, words: list[np.ndarray], times: list[np.ndarray], lengths: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float) -> None:
        self.words, self.sizes, self.idf = words, sizes, idf
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        tf = (np.concatenate(times) if times else np.zeros(0, np.int32)).astype(np.float64)
        score = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / max(mean, 1)))
        order = np.argsort(flat, kind="stable")
        self.posted, self.owner, self.score = flat[order], owner[order], score[order]
        self.unused = np.ones(len(words), bool)
        by_size = np.argsort(sizes, kind="stable")
        self.ranked, self.ranked_sizes = by_size.tolist(), sizes[by_size].tolist()

    def take(self, item: int) -> None:
        self.unused[item] = False

    def neighbours(self, seed: int, room: int) -> np.ndarray:
        """Unused items that fit, most like the seed first."""
        words = self.words[seed]
        lo, hi = np.searchsorted(self.posted, words), np.searchsorted(self.posted, words, "right")
        # Words that only the seed has retrieve nobody.
        shared = hi - lo > 1
        lo, size = lo[shared], (hi - lo)[shared]
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        owner = self.owner[at]
        ok = self.unused[owner] & (self.sizes[owner] <= room)
        score = np.bincount(owner[ok], weights=self.score[at][ok], minlength=len(self.sizes))
        items = np.flatnonzero(score > 0)
        return items[np.lexsort((items, -score[items]))]

    def largest_fitting(self, room: int) -> int | None:
        i = bisect.bisect_right(self.ranked_sizes, room) - 1
        while i >= 0 and not self.unused[self.ranked[i]]:
            self.ranked.pop(i)
            self.ranked_sizes.pop(i)
            i -= 1
        return self.ranked[i] if i >= 0 else None


def pack_shard(rows: pd.DataFrame, capacity: int, idf: np.ndarray, mean: float, name: str) -> pd.DataFrame:
    """PACKED for the texts of one shard."""
    out: list[tuple] = []
    count = 0
    doc, tokens = rows["doc_id"].tolist(), rows["tokens"].to_numpy(np.int64)
    for d, n in zip(doc, tokens.tolist(), strict=True):
        for piece in range(n // capacity if n > capacity else 0):
            out.append((f"{name}-{count}", d, piece, piece * capacity, capacity))
            count += 1
    sizes = np.where(tokens > capacity, tokens % capacity, tokens)
    words = [np.frombuffer(w, np.int32) for w in rows["words"]]
    times = [np.frombuffer(w, np.int32) for w in rows["times"]]
    shard = _Shard(words, times, rows["n_words"].to_numpy(np.float64), sizes, idf, mean)
    shard.unused &= sizes > 0
    for seed in np.argsort(-sizes, kind="stable").tolist():
        if not shard.unused[seed]:
            continue
        room = capacity - int(sizes[seed])
        shard.take(seed)
        content = [seed]
        if room:
            near = shard.neighbours(seed, room)
            while len(near):
                item = int(near[0])
                shard.take(item)
                content.append(item)
                room -= int(sizes[item])
                near = near[1:][sizes[near[1:]] <= room]
        while room and (item := shard.largest_fitting(room)) is not None:
            shard.take(item)
            content.append(item)
            room -= int(sizes[item])
        for item in content:
            first = int(tokens[item] - sizes[item])
            out.append((f"{name}-{count}", doc[item], first // capacity, first, int(sizes[item])))
        count += 1
    return pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])


def pack(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, shard: int = SHARD
) -> DataFrame:
    """PACKED: the container of each text, or of each piece of a text above the capacity."""
    spark = documents.sparkSession
    texts = cut(sized(documents, doc_id, text, vocabulary))
    n, mean = texts.agg(F.count("*"), F.avg("n_words")).first()
    frequency = frequencies(texts)
    idf = telling(frequency, n)
    sent = spark.sparkContext.broadcast((idf, (frequency >= 2) & (frequency <= max(2, n // 20))))
    shards = _anchored(texts, sent).repartitionByRange(max(1, math.ceil(n / shard)), "anchor", "doc_id")
    numbered = shards.withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts and sum(map(len, parts)):
            rows = pd.concat(parts, ignore_index=True).sort_values(["anchor", "doc_id"], kind="stable", ignore_index=True)
            yield pack_shard(rows, capacity, sent.value[0], mean or 1.0, f"{rows['shard'].iloc[0]}")

    return numbered.mapInPandas(run, PACKED)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, used: how full the containers are."""
    return packed.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn(
        "used", F.col("tokens") / (F.col("containers") * capacity)
    )
