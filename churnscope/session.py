"""Session construction and the shared checkpoint folder.

Library code never creates its own session; it receives one.  ``build_session``
exists for tests, the bench and the command line.  On a cluster the checkpoint
folder comes from ``spark.checkpoint.dir`` (a shared, reliable file system);
only a local-mode session without that setting gets a scratch folder.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants.  AQE re-plans joins from runtime
# sizes (broadcast only when the measured side is small), coalesces tiny
# shuffle partitions and splits skewed ones.
BASE_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = "local[*]",
    shuffle_partitions: int | None = None,
    app_name: str = "churnscope",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:  # None: keep the master given by spark-submit / the cluster
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:  # else Spark's or the cluster's setting
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def session_key(spark: SparkSession) -> str:
    """A stable identifier of the running application."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring the context with it.

    Order: a folder already set on the context, then ``spark.checkpoint.dir``
    from the session.  Only a local-mode session with neither gets a fresh
    scratch folder; a cluster session without one is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running operators that cut lineage"
        )
    scratch = tempfile.mkdtemp(prefix="churnscope-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch
