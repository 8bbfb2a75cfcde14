"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it a folder of this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="hedera-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/hedera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table made by written() that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/hedera-" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
