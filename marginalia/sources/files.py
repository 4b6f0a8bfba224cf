"""Source trees as tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
EXTENSIONS = {
    "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "sh": "shell", "bash": "shell",
}
GENERATED = ("@generated", "do not edit", "code generated", "auto-generated", "autogenerated", "generated by")
HEAD_BYTES, LONG_FIRST_LINE = 8192, 2000


def language(path: Column, text: Column | None = None) -> Column:
    """The language by extension; a file of another or no extension is shell if its first line is a shell's shebang."""
    pairs = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    known = F.try_element_at(pairs, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    if text is None:
        return known
    first = F.substring_index(text, "\n", 1)
    return F.coalesce(known, F.when(first.startswith("#!") & first.contains("sh"), F.lit("shell")))


def is_generated(text: Column) -> Column:
    """Whether the head of a file says that it is generated, or its first line is too long to be written by hand."""
    head = F.lower(F.substring(F.encode(text, "UTF-8"), 1, HEAD_BYTES).cast("string"))
    marked = F.lit(False)
    for mark in GENERATED:
        marked = marked | head.contains(mark)
    return marked | (F.octet_length(F.substring_index(text, "\n", 1)) > LONG_FIRST_LINE)


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), rf"^(?:file:)?/*{re.escape(root.strip('/'))}/*", "")


def glob_pattern(glob: str) -> str:
    """An ignore glob as a regular expression over relative paths; `dir/` stands for all below it."""
    rooted = glob.startswith("/") or "/" in glob.rstrip("/")
    body = glob.strip("/") + ("/**" if glob.endswith("/") else "")
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?|\[[^\]]*\])", body):
        if part == "**/":
            out += "(?:.*/)?"
        elif part == "**":
            out += ".*"
        elif part == "*":
            out += "[^/]*"
        elif part == "?":
            out += "[^/]"
        elif part.startswith("["):
            out += part.replace("[!", "[^")
        else:
            out += re.escape(part)
    return ("^" if rooted else "(?:^|/)") + out + "(?:/|$)"


def ignored(path: Column, lines: Sequence[str]) -> Column:
    """Whether the last matching line of an ignore file excludes a path (`!` includes it again)."""
    out = F.lit(False)
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        out = F.when(path.rlike(glob_pattern(line.lstrip("!"))), F.lit(not keep)).otherwise(out)
    return out


def hidden(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.[^/]")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path, text of every file below a folder that all executors see; text is null where the bytes are no UTF-8.

    Folders are listed level by level, each level's by as many tasks as there are; a task lists a folder whole once it is
    one of many. The paths found are dealt out anew before anything is read, so that a tree with one large folder is
    read by all cores. (The built-in file reader passes over names that begin with a dot or an underscore, `__init__.py`
    among them.)
    """
    base = root.removeprefix("file://").rstrip("/")
    cores = spark.sparkContext.defaultParallelism
    folders, found = [""], []
    # The levels at the top are few; when there are folders enough for all cores, tasks walk the rest.
    while folders and len(folders) < 4 * cores:
        below = []
        for folder in folders:
            with os.scandir(os.path.join(base, folder)) as entries:
                for entry in entries:
                    name = f"{folder}/{entry.name}" if folder else entry.name
                    (below if entry.is_dir(follow_symlinks=False) else found).append(name)
        folders = sorted(below)

    def below_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                for top, _, names in os.walk(os.path.join(base, folder)):
                    yield pd.DataFrame({"path": [os.path.relpath(os.path.join(top, n), base).replace(os.sep, "/") for n in names]}, dtype=object)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open(os.path.join(base, path), "rb") as content:
                    data = content.read()
                try:
                    text = data.decode("utf-8")
                except UnicodeDecodeError:
                    text = None
                yield pd.DataFrame({"path": [path], "text": [text]})

    paths = spark.createDataFrame([(p,) for p in sorted(found)], "path STRING")
    deep = spark.createDataFrame([(f,) for f in folders], "folder STRING").repartition(max(1, len(folders)), "folder").mapInPandas(below_of, "path STRING")
    return paths.unionByName(deep).repartition(4 * cores, "path").mapInPandas(read, "path STRING, text STRING")


def latest(files: DataFrame, at: str = "walked_at") -> DataFrame:
    """files with one row for each path, that of the latest walk; of rows of one walk, one.

    The latest walk of each path is found over two narrow columns, and the texts stay where they are; only those of
    paths that stand twice in one walk are shuffled.
    """
    times = files.groupBy(F.col("path").alias("_path"), F.col(at).alias("_at")).agg(F.count("*").alias("_n"))
    newest = times.groupBy("_path").agg(F.max(F.struct("_at", "_n")).alias("_m")).select("_path", "_m.*")
    same = (F.col("path") == F.col("_path")) & F.col(at).eqNullSafe(F.col("_at"))
    once = files.join(newest.where("_n = 1"), same, "left_semi")
    return once.unionByName(files.join(newest.where("_n > 1"), same, "left_semi").dropDuplicates(["path"]))


def universe(files: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """path of every file that isn't ignored, hidden ones included; the repository's own folder is left out."""
    path = F.col("path")
    return files.where(~path.rlike(r"^\.git/") & ~ignored(path, ignore)).select("path")


def walk(files: DataFrame, ignore: Sequence[str] = (), languages: Sequence[str] = (), skip_generated: bool = True) -> DataFrame:
    """path, language, text of the source files to look at: not ignored, not hidden, of an enabled language, not generated."""
    path = F.col("path")
    found = files.where(~ignored(path, ignore) & ~hidden(path)).select("path", language(path, F.col("text")).alias("language"), "text")
    found = found.where(F.col("language").isin(*languages) if languages else F.col("language").isNotNull())
    return found.where(~F.coalesce(is_generated(F.col("text")), F.lit(False))) if skip_generated else found


def skipped(files: DataFrame) -> DataFrame:
    """path, reason of files that can't be read."""
    return files.where(F.col("text").isNull()).select("path", F.lit("not UTF-8").alias("reason"))
