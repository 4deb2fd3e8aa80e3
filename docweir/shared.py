"""The folder that driver and executors share, for what a query writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The URI in spark.checkpoint.dir. Where it is unset, a temporary folder in local mode; on a cluster, an error:
    a folder of the driver's machine is none of the executors'."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        base = found.get()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docweir-")
        atexit.register(shutil.rmtree, base[7:], True)
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below it, in the application's own one; the folder isn't there yet. The application's folder
    goes when the driver's process ends."""
    sc = spark.sparkContext
    own = f"{shared_base(spark)}/docweir-{sc.applicationId}"
    if own not in _owned:
        _owned.add(own)
        atexit.register(_delete, sc._jvm, sc._jsc.hadoopConfiguration(), own)
    return f"{own}/{uuid.uuid4().hex}"


_owned: set[str] = set()


def _delete(jvm, configuration, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(configuration).delete(path, True)
    except (Py4JError, OSError):
        # The JVM is gone already: what is left stays.
        pass


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: cuts the lineage and outlives lost executors.

    Whatever depends on how rows lie in partitions (row ids, partition numbers) is settled by it, once for all readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
