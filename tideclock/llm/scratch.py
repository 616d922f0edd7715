"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Where it is unset, which only a
local session may do, a temporary folder of this process is used instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tideclock-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tideclock/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage: a lost executor costs a re-read, never a
    recomputation. An empty ``df`` comes back empty with its schema.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`materialize` that no later plan reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold Arrow batches to ``rows`` rows, so that long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names of helper columns, with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
