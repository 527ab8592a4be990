"""Cuts of lineage that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, a local session makes one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set, and a cluster needs a shared folder for cuts of lineage")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="basaltql-"))
        folder = _own[0]
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: a Parquet table in the shared folder, read again with the schema it had. A checkpoint would keep
    what Catalyst knows of the columns, which grows with every round of a loop."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/basaltql/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
