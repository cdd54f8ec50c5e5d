"""Session helpers: sessions, table loading and staged tables in the cluster's shared folder.

Iterative operators cut their lineage by writing each round to the folder the cluster names in
``spark.checkpoint.dir``. Parquet is used instead of ``checkpoint()`` because its columns are
compressed and pruned on re-reading, and because the files outlive a lost executor.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sightline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; Arrow functions import it there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sightline-ship-")  # on the driver, whose file server hands it out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in root.rglob("*.py"):
            z.write(source, Path(root.name, source.relative_to(root)))
    context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only where the setting is absent, and only in local mode, is a temporary folder chosen here; on a cluster
    without the setting this raises, as nothing says which folder its machines share.
    """
    global _LOCAL_DIR
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        if _LOCAL_DIR is None:
            _LOCAL_DIR = tempfile.mkdtemp(prefix="sightline-")
            atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
        return f"file://{_LOCAL_DIR}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


_STAGED: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def clear_staged() -> None:
    """Delete what this driver has staged; results that read it must have been used by then. It is also called at exit."""
    for path, spark in list(_STAGED.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is over, and what is left belongs to no one
            pass
        _STAGED.pop(path, None)


class Staging:
    """Tables written once and read many times, in a folder of their own below :func:`shared_dir`.

    A result may read its staged tables when it is used, so they are kept while the driver lives;
    :func:`clear_staged` deletes them, at the latest when it ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{purpose}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        _STAGED[self.path] = spark

    def write(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.path}/{self._count:03d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a staged table that nothing will read again."""
        path = getattr(df, "_staged_path", None)
        if path:
            _delete(self.spark, path)
