"""Two states of a repository, and keys and verdicts of continuous integration."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, removed or modified between two snapshots (path, content_hash). Full outer join on path."""
    a = before.select("path", F.col("content_hash").alias("old"))
    b = after.select("path", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", change.alias("change"))


def scope_veto(planned: DataFrame, vetoed: DataFrame) -> DataFrame:
    """planned (provider, path) without what a tool's own configuration excludes."""
    return planned.join(vetoed, ["provider", "path"], "left_anti")


def inputs_key(schema: int, providers: Mapping[str, tuple[str, str]]) -> str:
    """The cache key of inputs: schema version and, in order of ids, each provider's version and configuration."""
    parts = [f"inputs_schema={schema}", *(f";{k}={v}@{c}" for k, (v, c) in sorted(providers.items()))]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def index_key(schema: int, providers: Mapping[str, tuple[str, str]], ruleset: int, index_schema: int) -> str:
    return hashlib.sha256(f"{inputs_key(schema, providers)};ruleset={ruleset};index_schema={index_schema}".encode()).hexdigest()


def config_hash(dump: str) -> str:
    return "sha256:" + hashlib.sha256(dump.encode()).hexdigest()


def config_hash_of(dump: Column) -> Column:
    """`config_hash` as a column."""
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(dump, "UTF-8"), 256))


def keys_of(providers: DataFrame, group: str, schema: int, ruleset: int, index_schema: int) -> DataFrame:
    """group, inputs_key, index_key of each group of providers (provider, provider_version, config_hash; one row each)."""
    part = F.concat(F.lit(";"), "provider", F.lit("="), "provider_version", F.lit("@"), "config_hash")
    parts = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("provider", part.alias("part")))), lambda x: x["part"]), "")
    inputs = providers.groupBy(group).agg(F.sha2(F.concat(F.lit(f"inputs_schema={schema}"), parts), 256).alias("inputs_key"))
    return inputs.withColumn("index_key", F.sha2(F.concat("inputs_key", F.lit(f";ruleset={ruleset};index_schema={index_schema}")), 256))


def version_key_of(binary: Column, config: Column) -> Column:
    """`version_key` as a column; null where the program is null."""
    return F.sha2(F.concat(F.encode(F.sha2(binary, 256), "UTF-8"), F.lit(b"\0"), F.encode(config, "UTF-8")), 256)


def readable_column(version: Column, current: int) -> Column:
    """`readable` as a column."""
    return (version <= current) & (F.lit(current) <= version + 1)


def version_key(binary: bytes | None, config: str) -> str | None:
    """The key of a provider; None (not cacheable) if its program can't be read."""
    if binary is None:
        return None
    return hashlib.sha256(hashlib.sha256(binary).hexdigest().encode() + b"\0" + config.encode()).hexdigest()


def restore_plan(index_hit: Column, inputs_hit: Column) -> Column:
    return F.when(index_hit, "use_index").when(inputs_hit, "rederive").otherwise("cold")


def readable(version: int, current: int) -> bool:
    """Whether a file of a schema version can be read: the current one and the one before."""
    return version <= current <= version + 1


def comparable(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """provider, comparable: whether rule set, version and configuration are those of the baseline."""
    a = baseline.select("provider", F.struct("ruleset", "provider_version", "config_hash").alias("was"))
    b = current.select("provider", F.struct("ruleset", "provider_version", "config_hash").alias("now"))
    return a.join(b, "provider", "full_outer").select("provider", F.coalesce(F.col("was") == F.col("now"), F.lit(False)).alias("comparable"))


def fatal(run_state: Column, strict: bool) -> Column:
    return (run_state == "PARTIAL") & F.lit(strict)
