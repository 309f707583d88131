"""Session-level helpers: table access, shared scratch tables, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> None:
    """Let Python workers find this package where the executors see the same folder as the driver."""
    env = spark.sparkContext.environment
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = env.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known]))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory (a file or a directory of part files)."""
    reachable(spark)
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files below a path; empty where there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(place)
    own = [] if found is None else list(found)
    own += [x for f in own if f.isDirectory() for x in files.listStatus(f.getPath())]
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in own))


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only in local mode without the setting (tests, a laptop) a folder beside the SQL
    warehouse is used and removed at the end; a cluster must name its own shared
    folder, and fails at once if it doesn't.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "local")
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse"), f"_scratch-{spark.sparkContext.applicationId}")
    if own not in _SCRATCH:
        _SCRATCH.add(own)
        atexit.register(shutil.rmtree, own.removeprefix("file:"), ignore_errors=True)
    return own


_SCRATCH: set[str] = set()


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Let the file system delete ``path`` when the driver ends."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage so that a result used several times is computed once, and
    survives the loss of executors because the files are on shared storage.  The
    table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly if it comes in fewer partitions than there are cores (one small file, say).

    Only looks at plans that read tables without an exchange; others, and inputs
    with enough partitions, stay as they are.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in (text := plan.toString()) or "AdaptiveSparkPlan" in text:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def distinct_by(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows over ``keys`` with map-side combine."""
    return df.groupBy(*keys).agg(F.lit(1).alias("_one")).drop("_one")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Project the named columns, so that extra columns of an input can't clash with internal ones."""
    reachable(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def blank(c: Column) -> Column:
    """True where a text is null, empty or only white space (Unicode)."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")
