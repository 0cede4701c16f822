"""Tables kept for the length of a session, in the folder that driver and executors share.

That folder is named by ``spark.checkpoint.dir``. Where the setting is unset, a
temporary one is set for the session in local mode (tests); on a cluster that is
an error, as executors would write to their own disks. A lost executor costs no more
than the tasks it was running, for what is written here stays. Tables lie in a
folder named by the application; delete it once the application has ended.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="trawlkit-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Paths of the tables that the running :func:`scope` has saved.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Collects the tables saved inside; the function it gives deletes them, but for those that the frames it gets still read."""
    held: list[str] = []
    token = _held.set(held)

    def drop(*keep: DataFrame) -> None:
        read = {f.rsplit("/", 1)[0] for df in keep for f in df.inputFiles()}
        kept = {p.rsplit("/", 1)[-1] for p in read}
        for path in [p for p in held if p.rsplit("/", 1)[-1] not in kept]:
            _delete(spark, path)
            held.remove(path)

    try:
        yield drop
    finally:
        _held.reset(token)
        if (outer := _held.get()) is not None:
            outer += held


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and reread: cuts lineage, fixes values, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    if (held := _held.get()) is not None:
        held.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Deletes the files behind a frame from :func:`saved` once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """A table that fewer tasks than there are cores would read, dealt out for work that is heavy on CPU; others as they are.

    A row group is read by one task, however many a file is cut into.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores or _fewer_groups(df, cores) else df


def _fewer_groups(df: DataFrame, cores: int) -> bool:
    """Whether ``df`` is read from fewer Parquet row groups than there are cores; only the footers of that many files are looked at."""
    files = df.inputFiles()
    if not 0 < len(files) < cores or not all(f.endswith(".parquet") for f in files):
        return False
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    groups = 0
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            groups += reader.getRowGroups().size()
        finally:
            reader.close()
    return groups < cores
