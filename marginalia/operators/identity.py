"""Identities of comments across revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import cosine
from marginalia.plans.lineage import cut


KEY = ("bound_symbol", "kind", "cosmetic_fingerprint")
#: Parts of the comments of one symbol and kind.
SALTS = 16


def ordinals(comments: DataFrame, partitions: int | None = None) -> DataFrame:
    """comments with ordinal: 0, 1, ... among those with equal symbol, kind and fingerprint, in scan order.

    One identity may hold much of a table (a shebang line does), so identities aren't partitions: rows are sorted in
    ranges of identity and scan order, numbered within each range, and shifted by what the ranges before hold of the
    same identity. Only identities that cross a border need a shift, so the list of shifts is no longer than the list
    of ranges.
    """
    n = partitions or int(comments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.split("path", "/"), F.col("span.start_byte"), F.col("id")]
    ranged = cut(comments.repartitionByRange(n, *KEY, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", *KEY).agg(F.count("*").alias("_n"))
    crossing = counts.groupBy(*KEY).agg(F.collect_list(F.struct("_range", "_n")).alias("_all")).where(F.size("_all") > 1)
    before = lambda r: F.aggregate(F.filter("_all", lambda x: x["_range"] < r["_range"]), F.lit(0).cast("bigint"), lambda a, x: a + x["_n"])
    shifts = crossing.select(*KEY, F.explode(F.transform("_all", lambda r: F.struct(r["_range"].alias("_range"), before(r).alias("_shift")))).alias("s")).select(*KEY, "s.*")
    within = F.row_number().over(Window.partitionBy("_range", *KEY).orderBy(*order))
    a, b = ranged.withColumn("_within", within).alias("a"), F.broadcast(shifts).alias("b")
    same = F.col("a._range") == F.col("b._range")
    for k in KEY:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    ordinal = (F.col("a._within") - 1 + F.coalesce("b._shift", F.lit(0))).cast("int").alias("ordinal")
    return a.join(b, same, "left").select(*[F.col(f"a.{c}") for c in comments.columns], ordinal)


def lookup(identities: DataFrame, keys: DataFrame) -> DataFrame:
    """The identities (bound_symbol, kind, cosmetic_fingerprint, ordinal, ...) of the keys asked for; a null symbol matches null."""
    a, b = identities.alias("a"), keys.select(*KEY).distinct().alias("b")
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left_semi")


def _two_smallest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, next: the two smallest ids of each key; every task keeps two for a key before the shuffle."""
    ranked = rows.select(*keys, "id").withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where("_nth <= 2")
    return ranked.groupBy(*keys).agg(F.min("id").alias("id"), F.min(F.when(F.col("_nth") == 2, F.col("id"))).alias("next"))


def match(queries: DataFrame, stored: DataFrame, least: float = 0.8, by_vector: bool = True) -> DataFrame:
    """query_id, id, tier: the other stored comment that each query is, by the first tier that has one.

    Tiers: 1 equal text, 2 equal symbol and fingerprint, 3 equal fingerprint under another symbol, 4 equal symbol and
    kind with a cosine of at least `least`, if exactly one candidate has it. Within a tier the smallest id wins. The
    first three tiers join with few rows for each key; the fourth compares each query with the comments of its symbol and
    kind, which are dealt out over SALTS, as a symbol like the module's own may hold much of a table.
    """
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("id", "content_hash", "bound_symbol", "cosmetic_fingerprint", "kind", "vector")])
    s = stored.select("id", "content_hash", "bound_symbol", "cosmetic_fingerprint", "kind", "vector")
    # The stored side has one row for each key before it is joined, so that a text which is everywhere costs one row.
    by_text, by_symbol = _two_smallest(s, ["content_hash"]), _two_smallest(s, ["cosmetic_fingerprint", "bound_symbol"])
    first = by_symbol.groupBy("cosmetic_fingerprint").agg(F.min(F.struct("id", "bound_symbol")).alias("one"))
    rest = by_symbol.join(first, "cosmetic_fingerprint").where(~F.col("bound_symbol").eqNullSafe(F.col("one.bound_symbol")))
    second = rest.groupBy("cosmetic_fingerprint").agg(F.min("id").alias("two"))
    by_print = first.join(second, "cosmetic_fingerprint", "left")

    def best(joined: DataFrame, tier: int) -> DataFrame:
        return joined.select("q_id", "id").where(F.col("id").isNotNull()).withColumn("tier", F.lit(tier))

    another = F.when(F.col("id") == F.col("q_id"), F.col("next")).otherwise(F.col("id"))

    other = F.when(F.col("q_bound_symbol").eqNullSafe(F.col("one.bound_symbol")), F.col("two")).otherwise(F.col("one.id"))
    tiers = [
        best(q.join(by_text, q["q_content_hash"] == by_text["content_hash"]).withColumn("id", another), 1),
        best(q.join(by_symbol, (q["q_cosmetic_fingerprint"] == by_symbol["cosmetic_fingerprint"]) & q["q_bound_symbol"].eqNullSafe(by_symbol["bound_symbol"])).withColumn("id", another), 2),
        best(q.join(by_print, q["q_cosmetic_fingerprint"] == by_print["cosmetic_fingerprint"]).withColumn("id", other), 3),
    ]
    if by_vector:
        dealt = q.where(F.col("q_vector").isNotNull()).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = s.where(F.col("vector").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        same = (dealt["q_bound_symbol"] == rows["bound_symbol"]) & (dealt["q_kind"] == rows["kind"]) & (dealt["_salt"] == rows["_salt"])
        near = dealt.join(rows, same).where((F.col("q_id") != F.col("id")) & (cosine(F.col("q_vector"), F.col("vector")) >= least))
        only = near.groupBy("q_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
        tiers.append(only.select("q_id", "id", F.lit(4).alias("tier")))
    union = tiers[0]
    for tier in tiers[1:]:
        union = union.unionByName(tier)
    chosen = union.groupBy(F.col("q_id").alias("query_id")).agg(F.min_by(F.struct("id", "tier"), "tier").alias("m"))
    return chosen.select("query_id", "m.id", "m.tier")
