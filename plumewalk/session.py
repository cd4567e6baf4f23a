"""Session helper and the two cluster-facing settings of the library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows one task may hold for a single key before a series is split into chunks.
DEFAULT_GROUP_ROWS = 2_000_000
GROUP_ROWS_KEY = "spark.plumewalk.maxGroupRows"


def get_session(app: str = "plumewalk", cores: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session you are given."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def group_limit(spark: SparkSession, limit: int | None = None) -> int:
    return int(limit or spark.conf.get(GROUP_ROWS_KEY, str(DEFAULT_GROUP_ROWS)))


def block_partitions(spark: SparkSession, rows: int, per_task: int = 4096) -> int:
    """Partitions for a step that does far more work than its input size shows, such as block kernels.

    Every core gets a few shares, so that uneven blocks even out; beyond that
    the count follows the rows up to the session's shuffle partitions.
    """
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(3 * spark.sparkContext.defaultParallelism, min(most, -(-rows // per_task)))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of its own only for a local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="plumewalk-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; the rows survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: nothing of its plan is kept.

    For the state of loops. A checkpoint keeps the size estimate of its plan;
    a state that is joined with itself in every round squares it, and after a
    few dozen rounds the estimate alone takes longer than the work.
    """
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
