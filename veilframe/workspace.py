"""Where intermediate tables and checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder of the cluster.

    The cluster names the folder in ``spark.checkpoint.dir``.  Only a local
    session, which has a single machine, may do without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="veilframe-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
