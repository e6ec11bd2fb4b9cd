"""Session helpers: a local session for tests, the shared scratch folder, and shipping of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "spark.millrace.shipped"


def local_session(cpus: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset (tests, one machine), a temporary folder is made and kept in the session;
    on a cluster an unset folder is an error, since executors cannot see the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.millrace.shared.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-millrace-")
    spark.conf.set("spark.millrace.shared.dir", made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later steps re-use the rows and lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote for frames that no later plan reads; any other frame is left alone."""
    for df in frames:
        if path := df.__dict__.pop("_written", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as spark-submit --py-files would.

    Rows that reach Python here are whole texts, so Arrow batches are cut to 1,000 rows where the session
    has Spark's default of 10,000.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if spark.conf.get(_SHIPPED, None) == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="spark-millrace-")) / "millrace_pkg.zip"
    with zipfile.ZipFile(out, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
