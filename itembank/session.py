"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("itembank")
    conf = {"spark.sql.shuffle.partitions": shuffle_partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true"}
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to spark.checkpoint.dir, as a cut in its lineage; only local sessions without that setting get a folder of their own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each context, as spark-submit --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_itembank_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="itembank-")) / "itembank.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._itembank_shipped = True
