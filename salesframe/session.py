"""Session helpers: settings, shared scratch folder, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "salesframe", extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the library assumes; a cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (extra or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset,
    as in tests on one machine, a temporary folder is made and remembered until
    the end of the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="salesframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table below the shared folder, apart for each application."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/salesframe/{spark.sparkContext.applicationId}"


def _files(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Hadoop knows them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has settled; tables made from it can't be read any more."""
    drop_written(spark, _scratch_root(spark))


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete one written table, whose readers are all done."""
    place, files = _files(spark, path)
    files.delete(place, True)


def scratch_tables(spark: SparkSession) -> set[str]:
    """The paths of all tables that this application has settled and not dropped."""
    root, files = _files(spark, _scratch_root(spark))
    return {s.getPath().toString() for s in files.listStatus(root)} if files.exists(root) else set()


@contextmanager
def passing_scratch(spark: SparkSession):
    """Drop at the end what was settled inside, but for the tables whose paths were added to the set given."""
    before, kept = scratch_tables(spark), set()
    yield kept
    names = {p.rstrip("/").rsplit("/", 1)[-1] for p in kept}
    for path in scratch_tables(spark) - before:
        if path.rsplit("/", 1)[-1] not in names:
            drop_written(spark, path)


def write_table(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """``settle`` that also tells the path, for ``drop_written``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For a table that several later passes need: they then read only their own
    columns, and lost executors cost no recomputation of what came before.
    """
    return write_table(df, name)[0]
