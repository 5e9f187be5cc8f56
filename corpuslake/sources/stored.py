"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset (tests on one machine) a temporary folder is made once and
    remembered in the session; on a cluster, whose executors would not see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpuslake.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-corpuslake-", dir="/tmp")
        spark.conf.set("corpuslake.shared.dir", found)
    return found


class _Open(threading.local):
    """Tables stored since each open ``scratch`` of this thread began."""

    def __init__(self):
        self.lists: list[list[DataFrame]] = []


_open = _Open()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage, so that a lost
    executor costs a reread and no step runs twice. ``by``: a column with a folder for each value."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslake/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _open.lists:
        _open.lists[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes what ``written`` has stored inside it once it is left."""
    own: list[DataFrame] = []
    _open.lists.append(own)
    try:
        yield
    finally:
        _open.lists.pop()
        released(*own)


def finished(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, stored; the tables stored on the way are deleted."""
    with scratch():
        out = written(make(), name)
        _open.lists[-1].pop()
    if _open.lists:
        _open.lists[-1].append(out)
    return out


def released(*stored: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for df in stored:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
