"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set a session in one
    process gets a temporary one; on a cluster executors could not see that."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tandemframe-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage
    ends here, and a lost executor costs no recomputation of what is above. The
    table goes when the session ends; that of ``instead_of``, an earlier cut
    which nothing else reads, goes at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tandemframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    if instead_of is not None:
        for old in {f.rpartition("/")[0] for f in instead_of.inputFiles()}:
            gone = jvm.org.apache.hadoop.fs.Path(old)
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. A text of one-byte characters may take the fast
    built-in; any other is translated letter by letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def crc_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def crc_bucket_py(doc_id, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def input_bytes(df: DataFrame) -> int:
    """Bytes that the plan of ``df`` knows its files to have; 0 where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def buckets(docs: DataFrame, each: int = 256 << 20) -> int:
    """Buckets of some operator's keys: twice the shuffle partitions, and as many
    more as the input has parts of ``each`` bytes, so that none outgrows a task."""
    return max(2 * partitions(docs.sparkSession), ceil(input_bytes(docs) / each))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
