"""Getting this package to the executors where they can't import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def importable() -> bool:
    """Whether Python workers find the package as the driver does: by PYTHONPATH or the working folder."""
    home = str(ROOT.parent)
    return home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == home


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless workers find it anyway."""
    sc = spark.sparkContext
    if importable() or getattr(sc, "_marginalia_shipped", False):
        return
    # The driver serves the archive to the executors, whatever file system they share.
    archive = Path(tempfile.mkdtemp(prefix="spark-package-"), "marginalia.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(ROOT.rglob("*.py")):
            out.write(file, file.relative_to(ROOT.parent))
    sc.addPyFile(str(archive))
    sc._marginalia_shipped = True
