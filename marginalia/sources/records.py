"""Small documents beside the tables: JSON lines, baselines, ledgers, configuration and blame."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.errors import ConfigError, StorageError
from marginalia.schema import COMMENTS

JSONL_VERSION = 1
BASELINE = "bound_symbol STRING, fingerprint STRING, rule STRING, reason STRING, date STRING"
LEDGER = "token STRING, id STRING, url STRING, closed BOOLEAN"
BLAME = "path STRING, line INT, commit_id STRING, author STRING, email STRING, committed_unix BIGINT"


class VersionError(StorageError, ValueError):
    """A file of a schema version that can't be read."""


def read_jsonl(spark: SparkSession, path: str, version: int = JSONL_VERSION) -> DataFrame:
    """Comments from JSON lines: a header with schema_version, then one comment a line. An empty file is an error.

    The header is the only line that has no comment's id; it is looked for in all files, as one file of several has it.
    """
    lines = spark.read.text(path)
    is_header = F.get_json_object("value", "$.schema_version").isNotNull() & F.get_json_object("value", "$.id").isNull()
    found = lines.where(F.col("value").contains('"schema_version"') & is_header).agg(F.max(F.get_json_object("value", "$.schema_version").cast("int"))).first()[0]
    if found is None:
        raise VersionError(f"{path}: no header")
    if found > version:
        raise VersionError(f"{path}: written by a newer version")
    return lines.where(~is_header).select(F.from_json("value", COMMENTS).alias("c")).select("c.*")


def _toml(path: str, version: int) -> dict[str, Any]:
    file = Path(path)
    try:
        raw = tomllib.loads(file.read_text()) if file.exists() else {}
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(f"{path}: {error}") from error
    if raw.get("version", version) > version:
        raise VersionError(f"{path}: version {raw['version']} is newer than {version}")
    return raw


def _tables(spark: SparkSession, path: str, version: int, schema: str, rows_of: Callable[[dict[str, Any]], list[tuple]]) -> DataFrame:
    """Rows of the tables of a TOML file, or of its parts below a folder; each table is parsed by itself, in a task.

    A missing file has no rows. Strings of several lines may not have one that begins with a bracket.
    """
    try:
        chunks = spark.read.option("lineSep", "\n[").text(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    # Lines that begin with a bracket begin a table; splitting there takes the bracket away.
    cut_off = F.col("value").rlike(r"\A\[\w+\]\]") | ~F.col("value").rlike(r"\A(?:\[|\s*\z|#|\w+\s*=)")
    text = F.when(cut_off, F.concat(F.lit("["), "value")).otherwise(F.col("value"))
    stated = chunks.agg(F.max(F.regexp_extract("value", r"(?m)\Aversion\s*=\s*(\d+)", 1).try_cast("int"))).first()[0]
    if stated is not None and stated > version:
        raise VersionError(f"{path}: version {stated} is newer than {version}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for t in batch["value"] for r in rows_of(tomllib.loads(t))], columns=columns)

    return chunks.select(text.alias("value")).mapInPandas(run, schema)


def read_baseline(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """BASELINE from TOML, a file or a folder of parts; a missing one is an empty baseline."""
    fields = ("bound_symbol", "fingerprint", "rule", "reason", "date")
    return _tables(spark, path, version, BASELINE, lambda raw: [tuple(e.get(f) for f in fields) for e in raw.get("entries", [])])


def read_ledger(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """LEDGER from TOML, a file or a folder of parts; a missing one is an empty ledger."""
    return _tables(spark, path, version, LEDGER, lambda raw: [(t, e["id"], e.get("url"), bool(e.get("closed", False))) for t, e in raw.get("issues", {}).items()])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """name, document: recorded outputs of tools, one file each."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"), F.col("value").alias("document"))


_PORCELAIN = re.compile(r"^([0-9a-f]{40}) \d+ (\d+)")


def parse_blame(dumps: DataFrame) -> DataFrame:
    """BLAME from (path, dump) with the output of `git blame --line-porcelain`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, dump in zip(batch["path"], batch["dump"], strict=True):
                now: dict[str, Any] = {}
                for line in dump.split("\n"):
                    if m := _PORCELAIN.match(line):
                        now = {"commit_id": m[1], "line": int(m[2])}
                    elif line.startswith("author "):
                        now["author"] = line[7:]
                    elif line.startswith("author-mail "):
                        now["email"] = line[12:].strip("<>")
                    elif line.startswith("committer-time "):
                        now["committed_unix"] = int(line[15:])
                    elif line.startswith("\t") and now:
                        rows.append((path, now["line"], now["commit_id"], now.get("author"), now.get("email"), now.get("committed_unix")))
            yield pd.DataFrame(rows, columns=["path", "line", "commit_id", "author", "email", "committed_unix"])

    return dumps.where(F.col("dump").isNotNull()).select("path", "dump").mapInPandas(run, BLAME)


def merge_config(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Configuration layers, the most specific first: field by field the first that sets it; maps are united by key."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            if isinstance(value, Mapping):
                out[key] = merge_config(out.get(key, {}), value)
            elif value is not None and key not in out:
                out[key] = value
    return out


def read_config(folder: str, name: str = "marginalia.toml", env: Mapping[str, str] | None = None, version: int = 1) -> dict[str, Any]:
    """The configuration for a folder: variables MARGINALIA_SECTION_KEY, then the files of it and of each folder above."""
    prefix = "MARGINALIA_"
    from_env: dict[str, Any] = {}
    for key, value in (env or {}).items():
        if key.startswith(prefix):
            section, _, field = key.removeprefix(prefix).lower().partition("_")
            from_env.setdefault(section, {})[field] = value
    here = Path(folder).resolve()
    files = [p / name for p in (here, *here.parents) if (p / name).exists()]
    layers = [_toml(str(f), version) for f in files]
    return merge_config(from_env, *layers)
