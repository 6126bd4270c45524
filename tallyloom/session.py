"""Session construction and the few things every operator asks of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", app: str = "tallyloom", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on a single machine may leave it unset (tests): a local temporary
    folder is taken and the setting filled in.  On a cluster that would scatter a table
    over the machines, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A fresh path below the shared folder for a table that cuts lineage.

    It is removed when the ``scratch`` block around the call ends, a ``lasting`` one or
    one outside of blocks with the driver."""
    root = f"{shared_dir(spark)}/tallyloom-{spark.sparkContext.applicationId}"
    fs, at = file_system(spark, root)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    if (open_blocks := _BLOCKS.get()) and not lasting:
        open_blocks[-1].append(path)
    return path


_BLOCKS: ContextVar[tuple[list[str], ...]] = ContextVar("scratch_blocks", default=())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose tables are removed at its end.

    It gives a ``keep(df, name)`` that works as ``cut`` but whose table belongs to the
    block around this one: what the block returns has to be kept.
    """
    outer, made = _BLOCKS.get(), []
    token = _BLOCKS.set((*outer, made))

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _BLOCKS.set(outer)
        try:
            return cut(df, name)
        finally:
            _BLOCKS.reset(inner)

    try:
        yield keep
    finally:
        _BLOCKS.reset(token)
        for path in made:
            remove(spark, path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it again.

    The copy outlives executors, so later jobs neither recompute the plan nor
    depend on blocks of one machine.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows, else as it is, for the
    engine to shuffle; it is counted, so it should stand in a table already."""
    return F.broadcast(df) if df.count() <= most else df


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file (a folder of part files is none)."""
    fs, at = file_system(spark, path)
    return fs.getFileStatus(at).isFile()
