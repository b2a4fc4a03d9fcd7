"""Session helpers: a tuned local session and lineage cutting that survives executor loss."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reelspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); one is set here only where none is and all runs on this machine.

    A folder of this machine would be another folder on each executor of a cluster, so there an unset one is an error.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not is_local(sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="reelspark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there; losing an executor loses nothing.

    A written table rather than ``checkpoint()``: a checkpointed plan keeps the constraints of the plan before it, which
    grow without end in iterative algorithms.  The application's tables are removed when Python exits.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/reelspark-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


_FOLDERS: set[str] = set()


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` wrote, when nothing that is still to run reads it."""
    _remove(df.sparkSession, df._written)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has been written: they stay until the driver collects its garbage, which may be never."""
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        pass


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers; needed where it is not installed on them."""
    import shutil
    from pathlib import Path

    home = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='reelspark-package-')}/reelspark", "zip", home.parent, home.name)
    spark.sparkContext.addPyFile(archive)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
