"""Session helpers: input tables, the shared folder, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import atexit
import io
import math
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a file or a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_mediasift", False):
        return
    package = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    where = f"{scratch(spark, 'code')}/mediasift.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(packed.getvalue())
    finally:
        out.close()
    sc.addPyFile(where)
    sc._mediasift = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset a folder of this machine serves, but only in local mode: on a
    cluster it is an error, as others can't read it and what is there goes with the machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='mediasift-')}"
        atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends: results may be read from it until then."""
    where = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, where)
    return where


def remove(spark: SparkSession, where: str) -> None:
    """Deletes a folder of the shared file system; nothing if it isn't there or the session has ended."""
    try:
        fs, path = hadoop_path(spark, where)
        fs.delete(path, True)
    except Exception:  # the JVM is gone: the folder stays
        pass


def hadoop_path(spark: SparkSession, where: str):
    """The file system and path object of an address."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cut(df: DataFrame) -> DataFrame:
    """Materialise and forget the lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lanes(spark: SparkSession, amount: float, each: float) -> int:
    """Tasks for steps that run again and again over a little: one per `each` of the `amount`, but one a core at least and no more than `width`. The width is that of a pass over whole tables: as
    each task costs something however little it gets, it would make every step dearer with the size of the whole."""
    return max(1, min(width(spark), max(spark.sparkContext.defaultParallelism, math.ceil(amount / each))))
