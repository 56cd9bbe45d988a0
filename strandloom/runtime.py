"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []
_WRITTEN: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as lazily scanned Parquet; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _clean_up() -> None:
    for d in _LOCAL_DIRS:
        shutil.rmtree(d, ignore_errors=True)


atexit.register(_clean_up)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach.

    It is the session's ``spark.checkpoint.dir``. Only a local master may go
    without: it gets a temporary folder, removed when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="strandloom-")
    _LOCAL_DIRS.append(d)
    spark.conf.set("spark.checkpoint.dir", f"file://{d}")
    return f"file://{d}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts the lineage: a lost executor costs its running tasks only, as
    the table's files outlive it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    if path.startswith("file://"):
        _LOCAL_DIRS.append(path[len("file://"):])
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables from the shared folder.

    Call it when no DataFrame built on them is needed any more; results that
    were returned but not yet written still read from them.
    """
    jvm = spark.sparkContext._jvm
    for path in _WRITTEN:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.clear()


def tmp_file(suffix: str = "") -> str:
    """A path in a temporary folder that is removed when the process ends."""
    d = tempfile.mkdtemp(prefix="strandloom-")
    _LOCAL_DIRS.append(d)
    return os.path.join(d, f"f{suffix}")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_strandloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = tmp_file("pkg")
    stage = os.path.join(os.path.dirname(base), "stage")
    shutil.copytree(
        os.path.join(root, "strandloom"), os.path.join(stage, "strandloom"), ignore=shutil.ignore_patterns("__pycache__", "*.pyc")
    )
    name = os.path.join(os.path.dirname(base), "strandloom_pkg")
    sc.addPyFile(shutil.make_archive(name, "zip", stage))
    sc._strandloom_shipped = True
