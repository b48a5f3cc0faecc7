"""Tables written to the shared checkpoint folder, to cut lineage and survive lost executors."""

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; release() removes the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df's partitions as they are to the shared folder; joins on what it is dealt by need no new shuffle.

    It is planned without adaptive execution, whose plans don't tell how their rows are dealt.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
        _made.append(spark.sparkContext.getCheckpointDir())
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            delete(table.sparkSession, folder)


def delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession, make) -> DataFrame:
    """What make() gives, materialized; all that was stored on the way to it is deleted."""
    before = len(_made)
    out = materialize(make())
    mine, kept = _made[before:-1], [_made[-1]]
    for path in mine:
        if path == spark.sparkContext.getCheckpointDir():
            kept.append(path)  # Spark goes on using it
        else:
            delete(spark, path)
    _made[before:] = kept
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that only tables written since have read."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete the tables that this process materialized; DataFrames that read them end with it."""
    while _made:
        delete(spark, _made.pop())
