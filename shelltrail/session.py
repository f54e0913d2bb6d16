"""Session helpers: where intermediate tables go, and who deletes them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
# staged tables by application, and those of the scopes that are open
_tables: dict[str, list[str]] = {}
_scopes: list[list[str]] = []


class NoSharedFolder(RuntimeError):
    """Executors on several machines need a folder that all of them reach."""


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; an own one only in local mode.

    ``spark.checkpoint.dir`` comes first, then the folder given to
    ``SparkContext.setCheckpointDir``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors reach")
    app = context.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="shelltrail-")
    return _own_folder[app]


def own_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder.

    What is written there belongs to the innermost ``owned`` block around the call; without one, or
    with ``keep``, it is deleted when the Python process ends.
    """
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    owner = _tables.setdefault(spark.sparkContext.applicationId, [])
    (_scopes[-1] if _scopes and not keep else owner).append(path)
    return path


def stage(df: DataFrame, name: str, compression: str = "snappy", keep: bool = False) -> str:
    """Write ``df`` as a table in the shared folder and return its path; see :func:`own_path`."""
    path = own_path(df.sparkSession, name, keep)
    df.write.option("compression", compression).parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once in the shared folder and read back.

    Cuts the lineage at a place that outlives executors, and lets several later
    passes share the work above it.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage(df, name))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals both sides by their keys, whatever size Spark expects.

    For tables that grow with the histories. Spark takes a staged table for as large as its files,
    and a broadcast passes through the driver: answers that are much alike, with their lists taken
    apart, are hundreds of times as large there.
    """
    return df.hint("merge")


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables, in whatever file system they are."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    paths.clear()


@contextlib.contextmanager
def owned(paths: list[str]) -> Iterator[None]:
    """What is staged inside the block is noted in ``paths``, whose owner deletes it."""
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete what was staged inside the block at its end: use the results before that."""
    paths: list[str] = []
    try:
        with owned(paths):
            yield
    finally:
        delete(spark, paths)


@atexit.register
def _delete_rest() -> None:
    spark = SparkSession.getActiveSession()
    # a stopped session leaves its tables to the cleaning of the shared folder
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            delete(spark, _tables.get(spark.sparkContext.applicationId, []))


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a scan, shuffled over all cores if it has fewer partitions than those.

    For work that costs far more than moving its rows. A scan of any size has
    enough partitions and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
