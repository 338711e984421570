"""Helpers shared by the corpus operators: what Python work needs from the session, and names that clash with none."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lexispark.staging import BROADCAST_ROWS, Stage, ordinals, small

__all__ = ["BROADCAST_ROWS", "Stage", "bounded_batches", "fresh", "ordinals", "read", "small"]

#: Most rows and bytes of an Arrow batch sent to Python: texts are long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def _ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_lexispark_sent", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="lexispark-")  # on the driver; Spark serves the file from there
    with zipfile.ZipFile(f"{folder}/lexispark.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(f"{folder}/lexispark.zip")
    sc._lexispark_sent = True  # noqa: SLF001
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def _bytes(value: str) -> int:
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = value.strip().lower().rstrip("bkmg") or "0"
    return int(digits) * unit.get(value.strip().lower()[len(digits) : len(digits) + 1] or "b", 1)


def bounded_batches(spark: SparkSession) -> None:
    """Prepare for Python work on texts: the executors get this package, and the session's Arrow batches are bounded in
    rows and bytes (lower settings stay). The settings hold on, as results are computed after an operator returns."""
    _ship(spark)
    for key, most, shown, number in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS, str(ARROW_ROWS), int),
        ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES, f"{ARROW_BYTES}b", _bytes),
    ):
        now = spark.conf.get(key, None)
        if now is None or not 0 < number(now) <= most:
            spark.conf.set(key, shown)


def fresh(*names: str) -> list[str]:
    """Column names that no table of a caller has."""
    mark = uuid.uuid4().hex[:12]
    return [f"_{n}_{mark}" for n in names]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
