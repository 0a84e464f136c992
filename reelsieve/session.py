"""Session helpers: the shared folder for intermediate tables, and cutting lineage in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, a local session) a temporary folder of this process is used,
    which is then also the session's checkpoint folder.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="reelsieve-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM has already gone
        pass


def shared_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder; it is removed when the process ends."""
    path = f"{shared_dir(spark)}/reelsieve-tables/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written once in the shared folder: it cuts the lineage, and later reads are pruned."""
    path = shared_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """As ``clustered``, over all of the session's shuffle partitions however few bytes there are: for work
    that costs much more than its rows weigh, which adaptive execution would otherwise put in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(F.lit(17), *keys)).sortWithinPartitions(*keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys in one partition, next to each other, for operators that walk over groups.

    It partitions by a hash of the keys of its own: Spark drops a repartition by the keys themselves
    where it takes its input to be partitioned so already, which adaptive execution may undo later
    because a Python operator declares no requirement.
    """
    return df.repartition(F.xxhash64(F.lit(17), *keys)).sortWithinPartitions(*keys)
