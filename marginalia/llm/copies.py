"""Copies hidden by layout: a ledger of canonical keys, kept up batch by batch.

Two comments are copies if their letters and digits are the same in the same order, ignoring case. A comment made of
two or more `name=value` / `name: value` fields only is compared by its set of fields, in any order.

The ledger holds one row per canonical key: bucket, key, copies, keep_id, and is stored as a table partitioned by bucket.
A batch is aggregated by key first (partial aggregation runs before the shuffle, so a key that holds a third of the rows
costs one row per task), then joined with the buckets it touches by a full outer join; counts add up, the smallest id
stays the representative, and these buckets are written anew, the others left alone.

Defined results: rows without id or text, and texts with fewer than `min_chars` letters and digits, take no part; a
row repeated with the same id counts once within a batch; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.lineage import cut, shared_folder

MIN_CHARS = 24
BUCKETS = 64
#: Files that a bucket is written in.
FILES = 4
LEDGER = "bucket INT, key BINARY, copies BIGINT, keep_id BIGINT"
#: A key is hot if it holds more than this share of the rows: there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.002
HOT_SALTS = 64

#: Comment marks and blanks around a field.
_EDGE = r"^[\s#/*\"'!<>-]+|[\s*/\"'!<>.-]+$"
_FIELD = r"^([\p{L}\p{N}_.-]+)\s*[=:]\s*(\S.*)$"


def _fold(text: Column) -> Column:
    """Letters and digits only, without case."""
    low = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    return F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "ſς", "sσ")


def canonical_text(text: Column) -> Column:
    """The canonical form of a comment's text."""
    parts = F.filter(
        F.transform(F.split(text, r"[;,|\r\n]+"), lambda x: F.regexp_replace(x, _EDGE, "")), lambda x: x != ""
    )
    is_fields = (F.size(parts) >= 2) & F.forall(
        parts, lambda x: x.rlike(_FIELD) & (F.length(_fold(F.regexp_extract(x, _FIELD, 2))) > 0)
    )
    fields = F.array_sort(
        F.transform(
            parts,
            lambda x: F.concat(
                _fold(F.regexp_extract(x, _FIELD, 1)), F.lit("\u0001"), _fold(F.regexp_extract(x, _FIELD, 2))
            ),
        )
    )
    looks = text.rlike(r"(?s)[=:].*[;,|\r\n].*[=:]")
    return F.when(looks & is_fields, F.concat(F.lit("\u0002"), F.array_join(fields, "\u0002"))).otherwise(_fold(text))


def keyed(comments: DataFrame, min_chars: int = MIN_CHARS, buckets: int = BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, bucket, key and the columns `carry` of every comment that counts."""
    return (
        comments.where(F.col("id").isNotNull() & F.col("raw_text").isNotNull())
        .select(F.col("id").cast("bigint").alias("id"), canonical_text(F.col("raw_text")).alias("canonical"), *carry)
        .where(F.length(F.regexp_replace("canonical", "[\u0001\u0002]", "")) >= min_chars)
        .select("id", F.unhex(F.md5("canonical")).alias("key"), *carry)
        .select("id", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key", *carry)
    )


def count_batch(batch: DataFrame) -> DataFrame:
    """A batch of `keyed` rows as a ledger of its own."""
    return batch.groupBy("bucket", "key").agg(F.count("*").alias("copies"), F.min("id").alias("keep_id"))


def merge(ledger: DataFrame, counted: DataFrame) -> DataFrame:
    """`ledger` with the counts of a batch (as `count_batch` makes them) added."""
    new = counted.select("bucket", "key", F.col("copies").alias("new_copies"), F.col("keep_id").alias("new_keep"))
    return ledger.join(new, ["bucket", "key"], "full_outer").select(
        "bucket",
        "key",
        (F.coalesce("copies", F.lit(0)) + F.coalesce("new_copies", F.lit(0))).alias("copies"),
        F.least("keep_id", "new_keep").alias("keep_id"),
    )


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger that is stored below a folder, partitioned by bucket; empty if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def update(folder: str, batch: DataFrame) -> None:
    """Add a batch of `keyed` rows to the ledger stored below a folder.

    Only the buckets that the batch has keys in are read and written anew; the numbers of these, at most as many as there
    are buckets, are all that comes to the driver. A batch that is added twice counts twice.
    """
    counted = cut(count_batch(batch))
    touched = [r.bucket for r in counted.select("bucket").distinct().collect()]
    if not touched:
        return
    old = stored(batch.sparkSession, folder).where(F.col("bucket").isin(touched))
    # What is read is overwritten, so it is kept first.
    merged = cut(merge(old, counted))
    dealt = merged.repartition("bucket", F.pmod(F.xxhash64("key", "bucket"), F.lit(FILES)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def membership(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """keep_id, copy_id of each keyed row that is a copy of an earlier one.

    The ledger has one row per key. Rows of hot keys are spread over salts, and their ledger rows are repeated for
    each salt; the list of hot keys has at most 1 / HOT_SHARE entries, whatever the size of the data.
    """
    groups = ledger.where("copies > 1")
    total = F.broadcast(ledger.agg(F.sum("copies").alias("total")))
    hot = groups.join(total, F.col("copies") > F.greatest(F.col("total") * HOT_SHARE, F.lit(1000))).select("key")
    hot = F.broadcast(hot.withColumn("hot", F.lit(True)))
    spread = groups.join(hot, "key", "left").select(
        "key",
        "keep_id",
        F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))).alias(
            "salt"
        ),
    )
    salted = rows.join(hot, "key", "left").select(
        "key",
        "id",
        F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(HOT_SALTS)).cast("int")).otherwise(F.lit(0)).alias("salt"),
    )
    return (
        salted.join(spread, ["key", "salt"])
        .where(F.col("id") > F.col("keep_id"))
        .select("keep_id", F.col("id").alias("copy_id"))
    )


def _rows(comments: DataFrame, increments: int, **settings: int) -> DataFrame:
    """Keyed rows with the time slice of their delivery, kept so that each increment reads them cheaply."""
    at = F.col("scanned_at").cast("timestamp")
    lo, hi = comments.agg(F.unix_micros(F.min(at)), F.unix_micros(F.max(at))).first()
    position = (F.unix_micros(at) - F.lit(lo or 0)) / F.lit((hi or 0) - (lo or 0) + 1)
    slices = comments.select("id", "raw_text", F.coalesce((position * increments).cast("int"), F.lit(0)).alias("slice"))
    return cut(keyed(slices, carry=("slice",), **settings).dropDuplicates(["id", "key"]))


def _ledger(rows: DataFrame, increments: int, folder: str | None) -> DataFrame:
    """The ledger after the deliveries of each time slice were added to it, one after the other."""
    folder = folder or f"{shared_folder(rows.sparkSession)}/ledger-{uuid4().hex}"
    for i in range(increments):
        update(folder, rows.where(F.col("slice") == i))
    return stored(rows.sparkSession, folder)


def distinct_comments(comments: DataFrame, increments: int = 3, folder: str | None = None, **settings: int) -> DataFrame:
    """keep_id, copies: one row per distinct comment."""
    return _ledger(_rows(comments, increments, **settings), increments, folder).select("keep_id", "copies")


def copies(comments: DataFrame, increments: int = 3, folder: str | None = None, **settings: int) -> DataFrame:
    """keep_id, copy_id over `comments`, whose deliveries are folded into a stored ledger in `increments` time slices.

    folder: where the ledger is stored; a new one in the shared folder if it is left out.
    """
    rows = _rows(comments, increments, **settings)
    return membership(rows, _ledger(rows, increments, folder))
