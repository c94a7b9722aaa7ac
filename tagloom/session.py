"""A Spark session with the settings that the engine is meant to run under; any other session works too."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tagloom", cores: int | str = "*", partitions: int | None = None, **more: str) -> SparkSession:
    n = partitions or (os.cpu_count() if cores == "*" else int(cores))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",  # buckets by page serve joins by page and place too
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.appName(name).config(map=conf | more)
    if not os.environ.get("SPARK_MASTER") and "spark.master" not in more:
        builder = builder.master(f"local[{cores}]")
    return builder.getOrCreate()


_MADE: list[tuple[SparkSession, str]] = []


def shared_place(spark: SparkSession) -> str:
    """A new path below the folder named in spark.checkpoint.dir; where that is unset and all runs on this machine, below a folder of this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/tagloom/{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder."""
    path = shared_place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder's owner removes what is left
            return
