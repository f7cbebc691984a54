"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    if set_by_cluster := sc.getConf().get("spark.checkpoint.dir"):
        return set_by_cluster
    if (known := sc._jsc.sc().getCheckpointDir()).isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="papergrid-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/papergrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables staged so far; results that still read them can't be computed afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def tasks(spark: SparkSession, least: int = 1) -> int:
    """Number of partitions for steps that are bound by CPU and not by bytes; explicit, so that AQE doesn't merge them."""
    return max(least, 3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the executors' Python workers, once for each context; needed where they can't import it by themselves."""
    sc = spark.sparkContext
    if not getattr(sc, "_papergrid_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="papergrid-code-"), "papergrid.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(archive))
        sc._papergrid_shipped = True
    return spark
