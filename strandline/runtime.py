"""What every operator needs from the session: shipped code, shared folders, unambiguous columns."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_OWN_DIRS: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python stages can import it there."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch, None) is None:  # not set: the default makes batches of long texts too large
        spark.conf.set(batch, "2000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="strandline-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir or the context's checkpoint folder; a local one only if driver and executors are one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not one_process(sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {sc.master} need a folder that all of them share")
        found = _OWN_DIRS.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="strandline-shared-"))
    return found.rstrip("/")


def one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by then
        pass


def shared_table(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage like checkpoint(): a lost executor costs nothing that is already written. The files
    stay until the driver's Python ends, since frames derived from them may be read at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Remove a shared table's files. Only for the frame that shared_table() returned, when nothing derived from it will be read again."""
    path = getattr(df, "_written", None)
    if path:
        _remove(df.sparkSession, path)


def own(df: DataFrame, *names: str) -> DataFrame:
    """Select columns by exact name, whatever else df holds (names that differ in case only, repeated names)."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("STRANDLINE_DRIVER_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
