"""Session defaults and the scratch space that operators share between stages."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folioflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python stages can import it there."""
    sc = spark.sparkContext
    if getattr(sc, "_folioflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="folioflow-")), "folioflow.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    # rows hold whole texts: batches for Python are bounded by bytes, not only by rows
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    sc._folioflow_shipped = True


class Scratch:
    """Tables in the folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Writing a table cuts the lineage: a lost executor costs its running tasks, not the stages before. The folder
    goes when the application ends; ``drop`` frees a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        sc = spark.sparkContext
        base = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_folioflow_scratch", None)
        if not base:
            if not sc.master.startswith("local["):  # executors would write to their own disks
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = sc._folioflow_scratch = tempfile.mkdtemp(prefix="folioflow-checkpoints-")
        self.spark = spark
        self.root = f"{base.rstrip('/')}/folioflow-{uuid.uuid4().hex}"
        self._path("").getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(self._path(""))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def table(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as read back. What was shuffled for it is deleted when it is written."""
        conf, cleanup = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(cleanup, "false")
        conf.set(cleanup, "true")
        try:
            df.write.option("compression", codec).parquet(f"{self.root}/{name}")
        finally:
            conf.set(cleanup, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
