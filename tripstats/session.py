"""Session construction and the shared scratch location."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tripstats",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session with the settings the operators assume: UTC, ANSI, AQE, no UI."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
        # keep generated methods JIT-compilable on HotSpot (see plans.catalog.codegen_session)
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect client."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext
        return None


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "connect")


def parallelism(spark: SparkSession, default: int = 8) -> int:
    sc = _context(spark)
    return sc.defaultParallelism if sc is not None else default


def child_session(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    """A session sharing ``spark``'s cluster with its own SQL settings, whose
    other settings start as copies of the caller's."""
    child = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            child.conf.set(k, v)
    for k, v in conf.items():
        child.conf.set(k, v)
    return child


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is the shared checkpoint folder the cluster names; a
    machine-local folder is created only when the session has none (tests).
    """
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc is not None:
        root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and sc is not None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="tripstats-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(root)
    elif sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_scratch(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below the scratch root."""
    return f"{scratch_root(spark)}/tripstats/{name}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """A ``file:`` URI (``file:/x``, ``file:///x``) as a plain path (for
    local-only helpers in tests); other paths unchanged."""
    return "/" + uri[len("file:"):].lstrip("/") if uri.startswith("file:") else uri


__all__ = ["build_session", "scratch_root", "new_scratch", "local_path", "app_id", "parallelism",
           "child_session"]
