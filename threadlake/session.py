"""Session defaults, table loading and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def get_session(app: str = "threadlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on (UTC, adaptive execution, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Only where none is named and the master is local (tests, one machine) a temporary folder is made and set; on a cluster
    such a folder would be another one on each machine, so that is an error.
    """
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="threadlake-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage: the copy survives the loss of any executor, is stored in columns, and its size is
    known to the planner. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/threadlake-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df for the side of a join that is broadcast if it has at most `most` rows, and joined by a shuffle beyond; it is written and counted once."""
    held = cut(df, "small")
    return F.broadcast(held) if held.count() <= most else held


def _sweep() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the gateway may be gone already at exit
            pass
    _written.clear()


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table made by cut() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getName().startswith("threadlake-"):
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions_for(rows: int, per_partition: int, spark: SparkSession) -> int:
    """Enough partitions to keep each under per_partition rows, and all cores in use for larger tables."""
    needed = -(-rows // per_partition)
    return max(1, needed if rows < 20_000 else max(needed, spark.sparkContext.defaultParallelism))
