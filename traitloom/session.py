"""Session helpers: where reliable checkpoints and intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from functools import partial

from pyspark.sql import DataFrame, SparkSession

# Folder of each table that ``cut`` wrote, as long as its DataFrame lives.
_folders: dict[int, tuple[weakref.ref, str]] = {}
# Name of each folder that is a table of the catalog.
_tables: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session, read from ``spark.checkpoint.dir``.

    Only a local session (tests) gets a folder of its own when none is named; on a
    cluster a machine-local folder would lose data with its machine, so we refuse.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is not None:
        return current.rsplit("/", 1)[0]
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    own = tempfile.mkdtemp(prefix="traitloom-checkpoint-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Beyond cutting the lineage this gives the planner true sizes, so a join with a small
    intermediate table is broadcast and one with a large table is not. (A checkpoint keeps
    the constraints of the plan it cuts; over many rounds those grow out of hand.)
    """
    spark = df.sparkSession
    path = work_path(spark, "cut")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[id(table)] = (weakref.ref(table, partial(_forget, id(table))), path)
    return table


def cut_by(df: DataFrame, *keys: str, tasks: int = 0, placed: bool = False) -> DataFrame:
    """Like ``cut``, bucketed by ``keys``: joins on all of them move only the other side. ``drop_cut`` deletes it.

    ``tasks`` is the number of buckets. ``placed`` tells that a join with such a table has put the rows in
    their places, so they are written where they are.
    """
    spark = df.sparkSession
    path, name, n = work_path(spark, "cut"), f"cut_{uuid.uuid4().hex}", tasks or task_count(spark)
    (df if placed else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    table = spark.table(name)
    _tables[path] = name
    _folders[id(table)] = (weakref.ref(table, partial(_forget, id(table))), path)
    return table


def _forget(key: int, _) -> None:
    _folders.pop(key, None)


def drop_cut(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more.

    Loops call this for the state of the round before; what a returned DataFrame still reads stays.
    """
    for frame in frames:
        sc = frame.sparkSession.sparkContext
        root = _folders.pop(id(frame), None)
        if root is not None:
            if root[1] in _tables:
                frame.sparkSession.sql(f"DROP TABLE IF EXISTS {_tables.pop(root[1])}")
            path = sc._jvm.org.apache.hadoop.fs.Path(root[1])
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, nor the other side: both are sorted and merged.

    For genotypes, variants and what is counted from them. Spark counts an array as one element and an
    exploded table as the rows before, and judges a table by the size of its files, so it takes these for
    a fraction of their size.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition on ``keys`` into a fixed number of tasks.

    For steps whose cost is computing, not bytes: adaptive execution would put many small
    groups into one task. A grouped step on the same keys needs no further shuffle.
    """
    return df.repartition(task_count(df.sparkSession), *keys)


def task_count(spark: SparkSession) -> int:
    """Tasks of a step whose cost is computing."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
