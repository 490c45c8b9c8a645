"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# SQL settings wanted everywhere; a cluster that sets one of them keeps its own value.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Added when this process starts a local master itself (tests, bench).
LOCAL_CONF = {
    "spark.driver.memory": "16g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "riskcard", extra: dict | None = None) -> SparkSession:
    """The active session, or a new one.

    Submitted to a cluster (no ``master`` given), only SQL settings that nobody set are filled in;
    the number of shuffle partitions and the driver's memory are the submitter's.
    """
    builder = SparkSession.builder.appName(app_name)
    conf = dict(extra or {})
    if master:
        builder = builder.master(master)
        conf = {**LOCAL_CONF, **conf}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    submitted = spark.sparkContext.getConf()
    for k, v in DEFAULT_CONF.items():
        if not submitted.contains(k):
            spark.conf.set(k, v)
    if master:
        spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names this folder.  It is only invented on a local master (tests), where driver
    and executors are one process; elsewhere a missing setting is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        # getCheckpointDir returns a per-app sub folder; its parent is ours.
        base = os.path.dirname(current.rstrip("/"))
        spark.conf.set("spark.checkpoint.dir", base)
        return base
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="riskcard-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", base)
    sc.setCheckpointDir(base)
    return base


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release_scratch() -> None:
    """Delete the scratch folders handed out so far, once nothing reads them any more."""
    from pyarrow import fs
    while _SCRATCH:
        store, path = fs.FileSystem.from_uri(_SCRATCH.pop())
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


_SHIPPED: set = set()


def ship_code(spark: SparkSession) -> None:
    """Make ``riskcard`` importable on executors (``addPyFile`` of a zip), once
    per application.  Grouped-map and pandas UDFs pickle references to package
    functions, so Python workers must be able to import the package, and on a
    cluster only shipped code is there.
    """
    import zipfile

    import riskcard
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(riskcard.__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="riskcard-pyfiles-", dir="/tmp"), "riskcard.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
