"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames in and returns DataFrames.  These helpers exist for tests,
benchmarks and the driver entry point.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: str | None = None


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "parasift") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PARASIFT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is read from the
    session.  Only when it is unset (local tests) is a private scratch folder
    created and registered.
    """
    global _SCRATCH
    current = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at storage shared by the cluster "
            "(a machine-local folder would not survive the loss of an executor)"
        )
    if _SCRATCH is None:
        _SCRATCH = tempfile.mkdtemp(prefix="parasift-ckpt-")
    spark.sparkContext.setCheckpointDir(_SCRATCH)
    return _SCRATCH


def write_scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in a new folder of the shared checkpoint folder
    and read it back: cuts the lineage, survives lost executors, and later
    reads prune columns.  Returns the rows and the folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that no plan reads any more."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``parasift`` importable in the Python workers.

    Zips the package once per driver process and hands it to
    ``SparkContext.addPyFile`` (Spark distributes it to every executor).  A
    no-op when the package already ships with the executors' environment.
    """
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="parasift-pkg-")
    zpath = os.path.join(out_dir, "parasift.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
