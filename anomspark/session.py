"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "anomspark") -> SparkSession:
    """Create (or reuse) a session with the settings the library relies on.

    On a cluster the master and most resources come from ``spark-submit``; only the
    semantic settings (UTC session time zone, AQE, Arrow) are forced here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.ansi.enabled": "true",
        # independent jobs (role tables, detectors) are submitted from several threads
        "spark.scheduler.mode": "FAIR",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return prepare_session(builder.getOrCreate())


#: Queries prepare the session from several threads; what is done once per context is done by one of them.
_ONCE = threading.RLock()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that value is used as
    is.  Only when nothing is set and the master is local (tests) a folder under the
    system temp dir is chosen; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    with _ONCE:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
            "spark.checkpoint.dir", None)
        if not configured:
            if not is_local(spark):
                # a machine-local folder would not survive the loss of the executor that wrote it
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            configured = tempfile.mkdtemp(prefix="anomspark-ckpt-")
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured


def default_parallelism(spark: SparkSession) -> int:
    """Number of partitions used for explicit range partitioning."""
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always present
        n = 200
    return max(1, n)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` into the session's checkpoint directory (cuts the
    lineage; survives executor loss).  Never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings the results depend on, applied to a session someone else created:
    naive timestamps are read as UTC (as the reference's epoch conversion does), and a
    reliable checkpoint directory must exist.  May be called from several threads at once."""
    with _ONCE:
        if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        ensure_checkpoint_dir(spark)
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per Spark context.

    The sources are zipped and handed to ``SparkContext.addPyFile``, which serves them to every
    executor, so a driver started from any folder works.
    """
    sc = spark.sparkContext
    with _ONCE:  # a second archive of the same name is refused
        if getattr(sc, "_anomspark_shipped", False):
            return
        root = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="anomspark-code-")) / "anomspark.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(f.relative_to(root.parent)))
        sc.addPyFile(str(out))
        sc._anomspark_shipped = True
