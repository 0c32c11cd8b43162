"""What the corpus operators share: table reading, saved intermediate tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

#: What an operator keeps in a Python worker between its tasks; the next operator there clears it.
remembered: dict = {}
#: Most bytes and rows of one Arrow batch of texts, and rows that Spark's Parquet reader holds at once: it keeps their texts in one array.
BATCH_BYTES, BATCH_ROWS, READ_ROWS = 4 << 20, 2000, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on reads texts and hands them to Python in small batches: both sides hold several copies of one."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(conf.get(key)).rstrip("b"))
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that df has no column of, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a local run gets one of its own; on a
    cluster, whose executors would not see it, that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidegrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor then costs no recomputation.

    The files go when the driver's JVM ends, whether its session was stopped or not, or earlier by used_up().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder, where = _located(spark, path)
    folder.deleteOnExit(where)
    found = spark.read.schema(df.schema).parquet(path)
    found.saved_at = path
    return found


def used_up(found: DataFrame) -> None:
    """Delete what saved() wrote for this table, which nothing reads any more, and let go of what its making left behind."""
    folder, where = _located(found.sparkSession, found.saved_at)
    folder.delete(where, True)
    tidy(found.sparkSession)


def tidy(spark: SparkSession) -> None:
    """Spark drops shuffle files and broadcasts of finished plans once the driver's garbage is collected, which by itself may be
    late: its heap then stands at the most it may have."""
    spark.sparkContext._jvm.System.gc()


def _located(spark: SparkSession, path: str):
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls are empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each run of `width` values, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out = op(out[:-size], out[size:])
        size *= 2
    if size < width:
        n, gap = len(values) - width + 1, width - size
        out = op(out[:n], out[gap : gap + n])
    return out


def window_hashes(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash mod 2**64 of each run of `width` codes, by doubling; codes should be well mixed."""
    power, size, total = np.uint64(base), 1, None
    done, at = 0, None
    rest, level = width, codes
    # binary decomposition of the width: the hash of a run is hash(left) * base**len(right) + hash(right)
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if total is None:
                    total, done = level, size
                else:
                    n = len(codes) - done - size + 1
                    total = level[:n] * at + total[size : size + n]
                    done += size
                at = _power(base, done)
            rest >>= 1
            if rest:
                level = level[:-size] * power + level[size:]
                power = power * power
                size *= 2
    return total


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64 (Steele, Lea and Flood 2014)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
