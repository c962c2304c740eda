"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that change results, not only speed; re-applied on sessions we did not build.
_SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant settings to a session made elsewhere."""
    for key, value in _SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "veilspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library wants; ``conf`` overrides any of them.

    ``master=None`` leaves the choice to spark-submit.  Shuffle partitions are left to AQE,
    which coalesces from a high initial number.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **_SEMANTIC_CONF,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ensure_conf(builder.getOrCreate())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints and state tables.

    On a cluster it lies below ``spark.checkpoint.dir``, which every executor can reach; only
    when that is unset (tests on one machine) is a local temporary folder used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        import uuid

        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="veilspan-"), name)
