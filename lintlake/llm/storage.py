"""Where operators keep what they must not compute twice: the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a temporary folder if all runs in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lintlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of a batch that goes to a Python worker, at most.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after lowering its session's Arrow batches to a size that workers can hold several copies of."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", conf.get(key)) or 0)
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; Spark removes it when the session ends."""
    path = f"{shared_folder(spark)}/lintlake/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a ``kept`` table that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)
