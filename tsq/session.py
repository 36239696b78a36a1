"""Session helpers: a local session for tests and a shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", app: str = "tsq", **conf: str) -> SparkSession:
    """A ``local[cores]`` session for tests and the bench (UI off, UTC)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**_LOCAL_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``.

    On a cluster this must be a shared folder (HDFS/S3/...) named by the
    deployment: without one, this raises an error.  Only a local master
    (tests, one machine) gets a folder of its own.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tsq-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def _scratch_folder(spark: SparkSession) -> str:
    """The folder of this application's scratch tables."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "tsq-tables", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    return os.path.join(_scratch_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def release_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables that this application has written so far.
    Results not yet written elsewhere read them: call it after that."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df, name: str = "stage"):
    """Compute ``df`` once and cut its lineage: written as a parquet table
    in the shared ``spark.checkpoint.dir`` and read back.  Used where a
    table that is small relative to its inputs (an aggregate of a large
    scan) feeds several consumers: the large input is read once, re-reads
    are columnar (pruned, pushed-down), and a lost executor re-reads the
    table instead of recomputing the scan."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tsq`` importable in the Python workers (UDFs pickle functions
    by module): zip the package once per application and ``addPyFile`` it;
    Spark copies it to every executor."""
    import zipfile

    import tsq

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(tsq.__file__)))
    base = ensure_checkpoint_dir(spark)
    local = base[len("file:"):] if base.startswith("file:") else base
    folder = os.path.join(local, "tsq-pkg") if "://" not in local else tempfile.mkdtemp(prefix="tsq-pkg-")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"tsq-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(os.path.join(root, "tsq")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
