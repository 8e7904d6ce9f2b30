"""Session helpers shared by every layer: table access and durable materialisation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a folder of its own is set only on one machine, where none is configured.
    On a cluster a folder of one machine would lose data with it, so there a missing setting is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="semframe-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables and files, beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared checkpoint folder and read that.

    Used where a costly or non-deterministic frame (a judge, a tokenizer, an iteration state) feeds several consumers.  The copy
    is on shared storage, so the loss of an executor loses nothing; being a table, it is read by column, and the optimizer
    knows its size, so what is small is joined without a shuffle.
    """
    spark = df.sparkSession
    if len({c.lower() for c in df.columns}) < len(df.columns) or re.search(r"\b(void|interval|variant)\b", df.schema.simpleString()):
        ensure_checkpoint_dir(spark)  # what a table cannot hold
        return df.checkpoint(eager=True)
    where = shared_folder(spark, "table")
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._written_at = where
    return out


def release(df: DataFrame) -> None:
    """Delete the table of a ``durable`` frame that nothing reads any more."""
    where = getattr(df, "_written_at", None)
    if where is not None:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
