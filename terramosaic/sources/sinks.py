"""Stage files, outputs and their paths."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from terramosaic import defaults
from terramosaic.shipping import shared_folder

logger = logging.getLogger(__name__)


def stage_path(key: str, base: str) -> str:
    return f"{base.rstrip('/')}/stages/{hashlib.sha256(key.encode()).hexdigest()}.parquet"


def materialize(df: DataFrame, key: str, base: str | None = None) -> DataFrame:
    """Write a stage (always anew) and return a scan of it; cuts lineage and fixes non-deterministic parts.

    ``base`` is a folder that driver and executors share; without one it is
    DATA_DIR, or the session's spark.checkpoint.dir. A plan must not read the
    stage that it overwrites.
    """
    path = stage_path(key, base or os.environ.get("DATA_DIR") or shared_folder(df.sparkSession))
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def log_action(name: str, action: Callable):
    """Run an action and log its duration."""
    began = time.monotonic()
    out = action()
    logger.info("%s: %.3f s", name, time.monotonic() - began)
    return out


def log_to(path: str, level: int = logging.INFO) -> None:
    logging.basicConfig(filename=path, level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)


def output_dir(folder: str = defaults.OUTPUT_DIR) -> Path:
    Path(folder).mkdir(parents=True, exist_ok=True)
    return Path(folder)


def output_path(name: str, folder: str = defaults.OUTPUT_DIR) -> Path:
    return output_dir(folder) / name


def normalized(path: str, folder: str = defaults.OUTPUT_DIR) -> Path:
    """A bare name goes into the output folder; a path with a folder stays. Parents are made."""
    out = Path(path) if Path(path).parent != Path(".") else output_path(path, folder)
    out.parent.mkdir(parents=True, exist_ok=True)
    return out


def geojson_path(folder: str = defaults.OUTPUT_DIR) -> Path:
    return output_path("output.geojson", folder)


def html_path(folder: str = defaults.OUTPUT_DIR) -> Path:
    return output_path("output.html", folder)


def write_text(text: str, path: str) -> Path:
    out = normalized(path)
    out.write_text(text, encoding="utf-8")
    return out


def write_geojson(collection: str, path: str) -> Path:
    """A feature collection, checked to be one."""
    if json.loads(collection).get("type") != "FeatureCollection":
        raise ValueError("not a feature collection")
    return write_text(collection, path)
