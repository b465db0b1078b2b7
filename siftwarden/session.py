"""Session helper for local runs; a cluster brings its own session."""

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app="siftwarden", cpus=None):
    cpus = cpus or os.environ.get("BENCH_CPUS") or "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-Xss8m")
        .config("spark.executor.extraJavaOptions", "-Xss8m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark):
    """The folder the cluster names in ``spark.checkpoint.dir``; only a local session may make its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder


def materialize(df):
    """Write an intermediate that is read more than once to the checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


# An input with less than this per core comes in too few splits to keep the cores busy.
SMALL_PER_CORE = 32 * 1024 * 1024


def estimated_bytes(df):
    """Size of an input as the optimizer knows it; nothing is run.  None when it is unknown."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


# Bytes of the files an input is read from, of one task of per-row pattern work: some seconds of the heaviest rules.
BYTES_A_TASK = 2 * 1024 * 1024


# Leaves of a plan whose size is that of files; of others it is derived, or a guess.
FILES = ("LogicalRelation", "DataSourceV2ScanRelation", "HiveTableRelation")


def read_bytes(df):
    """Size of the files a plan reads, whatever is joined or filtered; nothing is run."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [found.apply(i) for i in range(found.size())]
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in leaves if leaf.getClass().getSimpleName() in FILES)


def spread(df, factor=4):
    """Use every core for per-row pattern work, in tasks of bounded size.

    Files come in as many splits as they have row groups, some of them large, so rows are redistributed round-robin
    (a hot id cannot land in one task): over ``factor`` tasks a core, and over more where a task would have more than
    ``BYTES_A_TASK``, so that the longest task does not grow with the input.  What is large by the optimizer's estimate
    and fits one task is left as it is.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    if size is None:
        return df
    tasks = read_bytes(df) // BYTES_A_TASK
    if size <= SMALL_PER_CORE * cores:
        tasks = max(tasks, factor * cores)
    return df.repartition(tasks) if tasks > 1 else df
