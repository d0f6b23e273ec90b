"""Session settings, and the folder in which iterative operators cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "linkrank", **conf: str) -> SparkSession:
    """A session with adaptive execution; cluster settings win over these."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextmanager
def static_plans(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """Plans made inside keep their partitioning when they are cached or checkpointed, which adaptive ones don't. They
    shuffle to ``parts`` partitions, if given."""
    settings = {"spark.sql.adaptive.enabled": "false"} | ({"spark.sql.shuffle.partitions": str(parts)} if parts else {})
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a temporary one only for a local master that names none."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if current.isEmpty():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="linkrank-shared-"))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if the session is still there."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder; it goes when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/linkrank-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forgotten(df: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing will read again."""
    held = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if held.isDefined():
        delete(df.sparkSession, held.get())
