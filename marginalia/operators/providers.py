"""Results of external tools: JSON documents to findings, run states, and the cache of results."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from marginalia.errors import ProviderError
from marginalia.functions.places import byte_offset
from marginalia.functions.text import ESLINT_CATEGORY


@dataclass(frozen=True)
class Manifest:
    """Where a tool's JSON document holds its findings, and what its rules mean."""

    id: str
    iterate: str
    rule: str
    message: str
    file: str
    line: str
    column: str
    severity: str | None = None
    category_map: dict[str, str] = field(default_factory=dict)
    default_category: str | None = None
    keep_only_mapped: bool = False
    languages: tuple[str, ...] = ()
    comment_scoped: bool = False
    supports_fix: bool = False
    coordinate_system: str = "1-based-utf8"


def load_manifest(name: str, text: str) -> Manifest:
    """A manifest from TOML."""
    raw = tomllib.loads(text)
    if raw.get("manifest_version", 1) != 1:
        raise ProviderError(name, f"manifest version {raw['manifest_version']} is not known")
    f, c = raw["findings"][0], raw.get("capabilities", {})
    return Manifest(
        id=name, iterate=f.get("iterate", "$[*]"), rule=f["native_rule_id"], message=f["message"], file=f["file"], line=f["line"],
        column=f.get("column", "$.column"), severity=f.get("severity"), category_map={str(k): v for k, v in raw.get("category_map", {}).items()},
        default_category=raw.get("default_category"), keep_only_mapped=raw.get("keep_only_mapped", False), languages=tuple(raw.get("languages", ())),
        comment_scoped=c.get("comment_scoped", False), supports_fix=c.get("supports_fix", False), coordinate_system=c.get("coordinate_system", "1-based-utf8"),
    )


# Where these tools put things.
RUFF = Manifest(
    "ruff", "$[*]", "$.code", "$.message", "$.filename", "$.location.row", "$.location.column",
    category_map={
        **{f"D10{i}": "doc_missing" for i in range(8)}, "D417": "doc_drift", **{d: "doc_style" for d in ("D200", "D205", "D210", "D212", "D400", "D415")},
        "ERA001": "commented_code", "TD002": "todo_format", "TD003": "todo_format",
    },
    keep_only_mapped=True, languages=("python",), supports_fix=True,
)
SHELLCHECK = Manifest(
    "shellcheck", "$[*]", "$.code", "$.message", "$.file", "$.line", "$.column", severity="$.level",
    category_map={"2148": "shebang", "1090": "directive", "1091": "directive"}, keep_only_mapped=True, languages=("shell",),
)
GITLEAKS = Manifest(
    "gitleaks", "$[*]", "$.RuleID", "$.Description", "$.File", "$.StartLine", "$.StartColumn", default_category="secret", comment_scoped=True,
)
ESLINT = Manifest(
    "eslint", "$[*].messages[*]", "$.ruleId", "$.message", "$.filePath", "$.line", "$.column", severity="$.severity",
    category_map=dict(ESLINT_CATEGORY), keep_only_mapped=True, languages=("typescript", "javascript"), supports_fix=True, coordinate_system="1-based-utf16",
)
#: Letters of a row's hash that name its part of a group: sixteen to this power parts.
PART_LETTERS = 3
BUILT_IN = (RUFF, SHELLCHECK, GITLEAKS, ESLINT)


def run_state(document: Column, rows: Column) -> Column:
    """SKIPPED without a document, PARTIAL if it is no JSON, else EMPTY or SUCCESS by its number of findings."""
    text = F.trim(document)
    return (
        F.when(document.isNull() | (text == ""), "SKIPPED").when(F.try_parse_json(text).isNull(), "PARTIAL").when(rows > 0, "SUCCESS").otherwise("EMPTY")
    )


def _category(manifest: Manifest, rule: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in manifest.category_map.items() for x in kv]) if manifest.category_map else None
    mapped = F.try_element_at(pairs, rule) if pairs is not None else F.lit(None).cast("string")
    rest = manifest.default_category or (None if manifest.keep_only_mapped else "comment_style")
    return F.coalesce(mapped, F.lit(rest).cast("string"))


def normalise(runs: DataFrame, manifest: Manifest, document: str = "document") -> DataFrame:
    """One row for each finding in the documents of `runs`: provider_rule_id, category, message, file_path, line, column, ...

    Scalars come out as text; a missing line is 1, missing texts are empty; broken documents give no rows. Findings
    whose rule has no category are dropped.
    """
    outer, _, nested = manifest.iterate.removesuffix("[*]").partition("[*]")
    parsed = runs.where(F.col(document).isNotNull()).withColumn("_v", F.try_parse_json(F.col(document))).where(F.col("_v").isNotNull())
    inner = F.try_variant_get(F.col("_v"), outer, "array<variant>")
    kept = [c for c in runs.columns if c != document]
    rows = parsed.where(inner.isNotNull()).select(*kept, F.posexplode(inner).alias("nth", "_o")).withColumn("_f", F.col("_o"))
    if nested:
        # Findings stand below each outer item, which still tells the file.
        items = F.try_variant_get(F.col("_o"), f"${nested}", "array<variant>")
        below = rows.where(items.isNotNull()).select(*kept, F.col("nth").alias("_n"), "_o", F.posexplode(items).alias("_m", "_f"))
        rows = below.withColumn("nth", F.col("_n") * 100_000 + F.col("_m"))

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col("_f"), path, kind)

    rule = F.coalesce(get(manifest.rule), F.lit(""))
    return rows.select(
        *[c for c in runs.columns if c != document],
        "nth",
        F.lit(manifest.id).alias("origin"),
        F.concat_ws(":", F.lit(manifest.id), rule).alias("provider_rule_id"),
        rule.alias("canonical_rule_id"),
        _category(manifest, rule).alias("category"),
        (get(manifest.severity) if manifest.severity else F.lit(None).cast("string")).alias("severity_native"),
        F.coalesce(get(manifest.message), F.lit("")).alias("message"),
        F.regexp_replace(F.coalesce(get(manifest.file), F.try_variant_get(F.col("_o"), manifest.file, "string"), F.lit("")), r"^\./", "").alias("file_path"),
        F.coalesce(get(manifest.line, "int"), F.lit(1)).alias("line"),
        get(manifest.column, "int").alias("column"),
    ).where(F.col("category").isNotNull())


_SARIF = StructType(
    [
        StructField(
            "runs",
            ArrayType(
                StructType(
                    [
                        StructField(
                            "results",
                            ArrayType(
                                StructType(
                                    [
                                        StructField("ruleId", StringType()),
                                        StructField("level", StringType()),
                                        StructField("message", StructType([StructField("text", StringType())])),
                                        StructField(
                                            "locations",
                                            ArrayType(
                                                StructType(
                                                    [
                                                        StructField(
                                                            "physicalLocation",
                                                            StructType(
                                                                [
                                                                    StructField("artifactLocation", StructType([StructField("uri", StringType())])),
                                                                    StructField("region", StructType([StructField("startLine", IntegerType()), StructField("startColumn", IntegerType())])),
                                                                ]
                                                            ),
                                                        )
                                                    ]
                                                )
                                            ),
                                        ),
                                    ]
                                )
                            ),
                        )
                    ]
                )
            ),
        )
    ]
)


def from_sarif(runs: DataFrame, document: str = "document") -> DataFrame:
    """Findings of SARIF documents: the first location of each result, its line 1 by default."""
    kept = [c for c in runs.columns if c != document]
    parsed = runs.select(*kept, F.from_json(document, _SARIF).alias("s"))
    results = parsed.select(*kept, F.explode("s.runs").alias("run")).select(*kept, F.explode("run.results").alias("r"))
    place = F.try_element_at(F.col("r.locations"), F.lit(1))["physicalLocation"]
    return results.select(
        *kept, F.coalesce("r.ruleId", F.lit("")).alias("canonical_rule_id"), F.col("r.level").alias("severity_native"), F.coalesce("r.message.text", F.lit("")).alias("message"),
        F.coalesce(place["artifactLocation"]["uri"], F.lit("")).alias("file_path"), F.coalesce(place["region"]["startLine"], F.lit(1)).alias("line"),
        place["region"]["startColumn"].alias("column"),
    )


def locate(findings: DataFrame, files: DataFrame, system: str = "1-based-utf8") -> DataFrame:
    """findings with a zero-width span: the byte of line and column in the file's text; 0 where the text is missing."""
    texts = files.select(F.col("path").alias("file_path"), F.col("text").alias("_text"))
    base = 0 if system.startswith("0") else 1
    byte = F.coalesce(byte_offset(F.col("_text"), F.col("line"), F.coalesce("column", F.lit(base)), system), F.lit(0).cast("bigint"))
    span = F.struct(byte.alias("start_byte"), byte.alias("end_byte"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    return findings.join(texts, "file_path", "left").withColumn("span", span).drop("_text")


def latest(results: DataFrame, keys: tuple[str, ...] = ("content_hash", "provider", "provider_version"), at: str = "cached_at") -> DataFrame:
    """One row for each key: the latest delivery (of equal times the smallest document)."""
    rest = [c for c in results.columns if c not in keys]
    newest = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *[F.col(c) for c in rest if c != at])).alias("r"))
    return newest.select(*keys, "r.*")


def cached(needed: DataFrame, results: DataFrame) -> DataFrame:
    """needed (content_hash, provider, provider_version) with the cached result where one is complete, and `cached`."""
    keys = ["content_hash", "provider", "provider_version"]
    known = latest(results).where(F.col("run_state").isin("SUCCESS", "EMPTY"))
    return needed.join(known.withColumn("_hit", F.lit(True)), keys, "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def missing(needed: DataFrame, results: DataFrame) -> DataFrame:
    """The part of `needed` that has to be run."""
    keys = ["content_hash", "provider", "provider_version"]
    return needed.join(results.where(F.col("run_state").isin("SUCCESS", "EMPTY")), keys, "left_anti")


def set_hash(rows: DataFrame, group: str, path: str = "path", digest: str = "content_hash") -> DataFrame:
    """group, set_hash: a SHA-256 of each group's `path NUL hash LF` rows, whatever their order.

    Rows are hashed one by one and dealt to PARTS by the first letters of their hash; a part's hash is that of its sorted
    row hashes, the group's that of its parts' hashes. So no task holds a group's rows, only a part's hashes.
    """
    row = F.sha2(F.concat(F.col(path), F.lit("\u0000"), F.col(digest), F.lit("\n")), 256)
    hashed = rows.select(group, row.alias("_row")).withColumn("_part", F.substring("_row", 1, PART_LETTERS))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    return hashed.groupBy(group, "_part").agg(joined("_row").alias("_row")).groupBy(group).agg(joined("_row").alias("set_hash"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """old and new rows with one row for each key, that of the highest version; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth", "_new")
