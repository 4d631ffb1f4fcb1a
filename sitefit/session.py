"""Session helpers: conservative defaults for tests and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sitefit")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_scratch: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a scratch folder only for a local session without one."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _scratch:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _scratch[app] = shared or tempfile.mkdtemp(prefix="spark-")
    return _scratch[app]


#: Lineage cuts from one collection of the driver's garbage to the next.
CUTS_A_COLLECTION = 4
_cuts: dict[str, int] = {}


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job with a reliable checkpoint in the shared folder.

    A checkpoint keeps the size estimated for its plan, and the estimate of a join is the product of its sides. From round to round
    such a number gets several times as many digits, until reckoning with it takes the driver's time and memory; a table whose
    estimate has become absurd goes on as one of unknown size.

    Spark removes shuffle and checkpoint files once the driver has collected what refers to them, and a driver with little garbage
    seldom does; so it is asked to every few cuts, as ``spark.cleaner.periodicGC.interval`` does by time.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(spark))
    short = df.checkpoint(eager=True)
    app = context.applicationId
    _cuts[app] = _cuts.get(app, 0) + 1
    if _cuts[app] % CUTS_A_COLLECTION == 0:
        spark._jvm.System.gc()
    if absurd_size(short):
        return DataFrame(spark._jsparkSession.createDataFrame(short._jdf.javaRDD(), short._jdf.schema()), spark)
    return short


def absurd_size(df: DataFrame) -> bool:
    """Whether the planner estimates so many bytes for the rows (over two thousand exbibytes) that it writes their number as a power of ten."""
    return "E+" in df._jdf.queryExecution().optimizedPlan().stats().simpleString()


#: Most measured bytes of a join side that Spark may broadcast by itself.
BROADCAST_BYTES = 2 << 20


def joins_by_measured_size(spark: SparkSession) -> None:
    """Join sides are broadcast by the size they turn out to have, never by an estimate made before the query runs.

    An estimate starts from compressed files and does not see the rows that ``explode`` makes, so a side of a hundred million cells
    passes for a few kilobytes and is collected on the driver. Rulebook tables are broadcast by their own hints.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))


def new_table(spark: SparkSession) -> str:
    """A path in the shared folder that no other table has."""
    return f"{scratch_folder(spark)}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder, read back: like `cut`, but computed once and with sizes the planner can see."""
    spark = df.sparkSession
    path = path or new_table(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing will read again from the shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
