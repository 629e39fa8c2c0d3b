"""Session helpers: building a session for tests/bench and locating the shared
checkpoint folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "tempora",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the benchmark.  On a cluster, pass nothing: the
    existing session (and its configuration) is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder.  The cluster's ``spark.checkpoint.dir`` wins;
    only a local session without one (tests) gets a scratch folder; a cluster without
    one is an error, since its executors would write to their own disks."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and "cluster" not in sc.master:
        # one machine: the driver's scratch folder is every task's folder
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tempora-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table under the shared checkpoint folder
    and read it back: the lineage is cut, the data survive executor loss, and
    columns tagged with partition ids keep their values.  (Columnar files are
    far cheaper than ``checkpoint()``'s serialised rows.)"""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Round-robin repartition only when a scan yields fewer partitions than the
    cluster can run at once (e.g. one large row group), or than ``rows_per_task`` asks
    for: small rows that cost much work fill few splits however many they are.  Large
    inputs already arrive in many splits and are left alone — no extra shuffle at scale."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        want = max(want, -(-df.count() // rows_per_task))
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df
