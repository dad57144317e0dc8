"""Session helpers: the package for Python workers, and folders that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once per Spark application; no setting is changed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "watchloom.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.join("watchloom", os.path.relpath(full, top)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only where the session names none (a local run or a test) a temporary folder is set as
    the checkpoint folder first.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
