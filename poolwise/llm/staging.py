"""Tables written to the shared checkpoint folder, to cut lineage and to learn sizes before joins.

A staged table is Parquet below the session's ``spark.checkpoint.dir``, so every executor can read it and
a lost executor costs only its own tasks.  Staged folders go when the Python process ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_STAGED: list[tuple[SparkSession, str]] = []

#: Most bytes (as files) of a table that may be broadcast.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a local one is set only where none is and all runs on this machine."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="poolwise-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this repository, whatever the driver's working folder is."""
    env = spark.sparkContext.environment
    if _REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_REPO, env.get("PYTHONPATH", "")) if x)


def stage(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged_bytes(df: DataFrame) -> int:
    """Size on disk of a staged table, as Catalyst knows it from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its files are within ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if staged_bytes(df) <= limit else df


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def release() -> None:
    """Remove every staged table of this process; a session that has ended meanwhile keeps its folder."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            _drop(spark, path)
        except Exception:  # the JVM may have gone before this process
            return
