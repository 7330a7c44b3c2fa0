"""SparkSession defaults used by tests, bench and the CLI helpers.

On a cluster the session already exists and carries its own settings; these
helpers only fill what is unset (time zone, AQE, checkpoint dir for tests).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on. Time rules compare naive timestamps, so the
# session zone is pinned; AQE gives runtime broadcast / coalesce / skew split.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "stockflow") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("STOCKFLOW_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint dir; set a scratch one only when unset.

    On a cluster `spark.checkpoint.dir` names shared storage and is left
    alone. Only a session whose driver and executors are one process on this
    machine (master ``local``) may fall back to a fresh temp folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext; conf is enough there
        sc = None
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="stockflow-ckpt-")     # spark.checkpoint.dir itself can't be set any more
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's workers once, so that jobs run from any working directory.

    Functions inside the package are pickled by reference: workers must be able to import it. A
    session whose workers are forked from this process's own paths still gets the zip; it is small.
    """
    sc = spark.sparkContext
    if getattr(sc, "_stockflow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stockflow-ship-"), "stockflow_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._stockflow_shipped = True


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for written intermediates."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}"
