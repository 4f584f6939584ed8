"""Make the package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession

_DONE: dict[str, bool] = {}


def _folder(spark: SparkSession) -> Path:
    """A new folder for the archive: in the shared folder that spark.checkpoint.dir names where that is a path of
    a file system; else one of the driver's own, which the executors never need to see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or ""
    path = urlparse(named).path if named.startswith("file:") else named if named.startswith("/") else ""
    if path:
        Path(path).mkdir(parents=True, exist_ok=True)
    return Path(tempfile.mkdtemp(prefix="mailloom-src-", dir=path or None))


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors through Spark's own file server, once per application."""
    sc = spark.sparkContext
    if not _DONE.get(sc.applicationId):
        root = Path(__file__).resolve().parents[1]
        target = _folder(spark) / f"{root.name}_src.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        _DONE[sc.applicationId] = True
    return spark
