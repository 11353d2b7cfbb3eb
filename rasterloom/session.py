"""Sessions, and how the package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def session(app: str = "rasterloom", **config: str) -> SparkSession:
    """A session with the settings that the engine expects: AQE, UTC, Arrow batches of bounded size."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.chunkBase64String.enabled": "false",
    }
    for key, value in (defaults | config).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, unless their path has it: Arrow functions import it there."""
    roots = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if any(root and (Path(root) / _PACKAGE.name / "session.py").exists() for root in roots) or getattr(context, "_rasterloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="rasterloom-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in _PACKAGE.rglob("*.py"):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    context._rasterloom_shipped = True
