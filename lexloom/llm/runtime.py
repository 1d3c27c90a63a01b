"""What the operators share on the driver: checkpoints, sizes, row identity."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch sent to a Python worker.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine (``local`` master, as in tests) may name none.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or f"{tempfile.gettempdir()}/checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}")
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_in_small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, so that workers hold few texts at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle; the one knob that is raised with the cluster and the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str) -> Column:
    """128-bit identity of a row's content as 16 bytes; null columns hash like absent ones."""
    named = [F.col(c) for c in cols]
    halves = (F.xxhash64(*named), F.xxhash64(F.lit(0x5DEECE66D), *named))
    return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def keys_of(column: pa.Array) -> np.ndarray:
    """``row_key`` values of an Arrow column as an array of 16-byte items."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), "V16")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
