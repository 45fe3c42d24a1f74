"""Session factory and the shared folder for materialised intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "shelfmine", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; the cluster's own settings win unless given here."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # lists of query terms reach the Parquet reader as they are, not as the range that they span
        .config("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = spark.conf.get("spark.shelfmine.localFolder", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="shelfmine-")
        spark.conf.set("spark.shelfmine.localFolder", folder)
    return folder


def fresh_table_path(spark: SparkSession, stem: str) -> str:
    """A new path in the shared folder, never reused by another run."""
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


# files of a query's exchanges go when the query ends, not when the driver happens to collect its garbage
RELEASED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session with other settings, which end with the block."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def cut_lineage(df: DataFrame, stem: str = "step", compression: str | None = None) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back.

    The result survives the loss of any executor, is computed once however often it is used, and has known
    size and prunable columns. ``drop_steps`` deletes it when nothing reads it any more.
    """
    path = fresh_table_path(df.sparkSession, stem)
    df.write.parquet(path, compression=compression)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step._step_path = path
    return step


def drop_steps(*steps: DataFrame) -> None:
    """Delete the tables of frames that ``cut_lineage`` returned. Frames that read them can no longer be used."""
    for step in steps:
        path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step._step_path)
        path.getFileSystem(step.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
