"""What the corpus operators share: staged tables and words.

A *word* is a maximal run of bytes outside 0x20 and 0x09-0x0D; ``bytes.lower`` and
``bytes.split`` fold and cut exactly A-Z and those bytes, so words stay bytes.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}
_staged: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if folder:
        return folder
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_folders[app] = tempfile.mkdtemp(prefix="lastro-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return _own_folders[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    tables = f"{shared_folder(spark)}/lastro/{spark.sparkContext.applicationId}"
    if tables not in _staged:
        _staged.add(tables)
        atexit.register(_remove, spark, tables)
    path = f"{tables}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped before
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that is read no more; those of all others go when the driver's process ends."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs removed: Spark does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def as_bytes(texts: pa.Array, rows: int = 512) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, a few rows at a time."""
    for start in range(0, len(texts), rows):
        yield from texts.slice(start, rows).cast(pa.binary()).to_pylist()
