"""Sessions and tables that are written once between steps."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "graphspark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session as tests and the bench use it; on a cluster, bring your own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settled_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which driver and
    executors share; an own one, removed at the end, only in local mode."""
    app = spark.sparkContext.applicationId
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/settled-{app}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    atexit.register(shutil.rmtree, f"/tmp/graphspark-settled/{app}", ignore_errors=True)
    return f"file:///tmp/graphspark-settled/{app}"


def settled(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows neither
    grows the plan nor computes it twice, and survives a lost executor. With
    ``by``, a folder per value of that column: a filter on it reads that one alone."""
    path = f"{settled_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
    else:
        df.repartition(by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession) -> None:
    """Removes the application's settled tables; results that still read them
    must have been written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(settled_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
