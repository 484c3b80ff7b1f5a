"""Makes the package importable on executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may name none (a test) and gets a folder of its own; on
    a cluster that is an error.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='terramosaic-')}"
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once a session, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_terramosaic_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="terramosaic-py-"), "terramosaic.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, f"terramosaic/{file.relative_to(here)}")
    context.addPyFile(archive)
    context._terramosaic_shipped = True
