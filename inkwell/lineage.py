"""Cutting a plan's lineage at the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _root(df: DataFrame) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only where it is unset and all
    runs on one machine is a local folder taken."""
    context = df.sparkSession.sparkContext
    root = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint: for keys and the like."""
    _root(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder: for texts, which Parquet holds in a
    fraction of a checkpoint's room."""
    path = f"{_root(df).rstrip('/')}/texts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
