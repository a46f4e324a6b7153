"""Session set-up and the one place where intermediate tables are made durable."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "brackish", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; extra settings by keyword (dots as `__`)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def durable_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a private one only for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _private_folder()


@functools.cache
def _private_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_JOB: ContextVar[str | None] = ContextVar("job folder", default=None)


@contextmanager
def job(spark: SparkSession) -> Iterator[str]:
    """What is settled inside goes into one folder, which is removed at the end.

    Wrap the whole job, its action included: tables returned from it are computed lazily from that folder.
    """
    folder = f"{durable_folder(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    token = _JOB.set(folder)
    try:
        yield folder
    finally:
        _JOB.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def part_of_job(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A part of a job whose settled tables are removed at its end; the function it yields settles what stays."""
    outer = _JOB.get()
    with job(spark):

        def keep(df: DataFrame) -> DataFrame:
            inner = _JOB.set(outer)
            try:
                return settle(df)
            finally:
                _JOB.reset(inner)

        yield keep


def work_folder(spark: SparkSession) -> str:
    """The folder of the job that runs, or the shared one outside of jobs."""
    return _JOB.get() or durable_folder(spark).rstrip("/")


#: Shuffle files of a query that only writes end with it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` once, with these options of the writer, and read it back; its shuffle files are removed then.

    Three uses: the result is computed once however often it is used, it
    survives a lost executor, and its true size is known to the planner,
    which then broadcasts it below `spark.sql.autoBroadcastJoinThreshold`
    and shuffles it above - no broadcast hint is needed anywhere.
    """
    path = f"{work_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
