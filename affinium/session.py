"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def build_session(cores: str = "*", app: str = "affinium", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="affinium-ship-")) / "affinium"
        archive = shutil.make_archive(str(base), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def is_missing(error: AnalysisException) -> bool:
    """Whether a read failed because there is nothing at its path yet."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one in `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder, one
    per application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="affinium-")
    return _local_folders[app]


# Open scopes of each thread: a streaming batch runs in a thread of its own.
_threads = threading.local()


def _open_scopes() -> list[list[str]]:
    return _threads.__dict__.setdefault("scopes", [])


def fresh_path(spark: SparkSession, name: str) -> str:
    """New, unused path for one intermediate table."""
    return f"{shared_folder(spark)}/affinium/{name}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession):
    """Delete the tables that `materialise` writes inside, at the end.

    For work whose result is written before the scope ends; a lazy result
    must not leave it.
    """
    written: list[str] = []
    scopes = _open_scopes()
    scopes.append(written)
    try:
        yield
    finally:
        scopes.pop()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in written:
            path = hadoop(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(command):
    """Run a command `(spark, ...)` that writes its result in a scope of its own."""

    @wraps(command)
    def run(spark: SparkSession, *args, **options):
        with scope(spark):
            return command(spark, *args, **options)

    return run


def materialise(df, name: str, partition_by: list[str] | None = None):
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _open_scopes():
        _open_scopes()[-1].append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
