"""What the operators share: scratch tables in the cluster's shared folder, vector checks, byte words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them for Java's regular expressions: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode without one a folder of this process (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="hedera-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and any executor can read it again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/hedera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/hedera-" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite_vector(vec: Column) -> Column:
    """True for a vector that is not null or empty and has finite components only."""
    inf = float("inf")
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ok, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A list column whose lists have one length as a float64 matrix."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def lowered_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; bytes methods know ASCII letters and ASCII white space only."""
    return text.lower().split() if text else []


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batches, name: str, most: int = 2 << 20):
    """Batches cut so that each has at most `most` bytes in a string column, or one row."""
    for batch in batches:
        size = pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] - size[start] + most, side="right"))
            stop = max(start + 1, stop)
            yield batch.slice(start, stop - start)
            start = stop


def lean(run):
    """run, for mapInArrow; what a task has used goes back to the system when it ends. A worker serves tasks of many stages, and
    memory that it keeps after one stage adds to what the next one needs."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
