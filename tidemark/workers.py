"""Makes this package importable in Spark's Python workers, wherever the driver has it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_EQUIPPED: set[str] = set()


def equip(spark: SparkSession | None = None) -> None:
    """Gives the package's sources to the session's workers, once per application.

    Spark itself sends the file from the driver to every executor, also to those that join later.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _EQUIPPED:
        return
    home = Path(__file__).resolve().parent
    if home.suffix == ".zip" or not home.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{home.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(home.rglob("*.py")):
            archive.write(source, source.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(path))
    _EQUIPPED.add(spark.sparkContext.applicationId)
