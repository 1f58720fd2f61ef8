"""Spark session helpers.

The library never creates its own cluster resources beyond what a Spark user
would: it reads the session's configuration and only fills in settings that
are unset (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: ANSI-safe arithmetic is handled in the
# operators (try_divide / try_cast), AQE re-plans joins and coalesces
# shuffle partitions at runtime, skew-join splitting protects hot keys.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "salescope",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.ui.enabled", "false")
    # local runs: the driver JVM is the whole cluster
    builder = builder.config("spark.driver.memory", os.environ.get("SALESCOPE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``salescope`` importable in the Python workers (pandas UDFs and
    ``mapInPandas`` functions are pickled by module reference): the package
    is zipped once per process and added to the context like ``--py-files``."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="salescope-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; without
    it this raises.  Only a local master, whose single machine is the whole
    cluster, gets a fresh local folder when nothing is configured.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="salescope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables next to the session's checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "salescope-tables", name)


def store(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the checkpoint folder and read back:
    what reads it several times prunes its columns, repeats none of its joins
    and knows its size; the shuffles behind it are deleted.  Types that Parquet
    has not are checkpointed instead."""
    spark = df.sparkSession
    names = df.columns
    types = df.schema.simpleString()
    if not names or "void" in types or "interval" in types:
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])   # any header will do
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/salescope-tables/rows-{uuid.uuid4().hex}"
    with passing_shuffles(spark):
        plain.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(plain.schema).parquet(path).toDF(*names)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``store`` wrote and nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Actions inside delete their shuffle files when they end; otherwise the
    files stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
