"""Things every operator needs from the Spark session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
# Bytes of a batch that goes to a Python worker, where the session has Spark's default: executors hold several at a time.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "8m", "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run, and keep their batches small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, DEFAULT_BATCH_BYTES) == DEFAULT_BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="logsift-pkg-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"logsift_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster: spark.checkpoint.dir. Where it is unset and all runs on this machine, a temporary folder is;
    elsewhere that would be a folder of each machine's own, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="logsift-shared-")
        atexit.register(shutil.rmtree, root[7:], True)
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; Spark creates it when it writes there."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """The path of a file: URI on a mount that all machines share."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: a mounted shared folder (file:) is needed here")
    return uri
