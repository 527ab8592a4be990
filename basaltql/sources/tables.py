"""Reading tables, literal row sets, series, files of other formats, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(spark: SparkSession, sf_dir: str, prefix: str = "", names: tuple[str, ...] = TABLES) -> None:
    """The tables of a folder as temporary views; a prefix keeps those of two folders apart."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(prefix + name)


def detach(spark: SparkSession, prefix: str = "", names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        spark.catalog.dropTempView(prefix + name)


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """value from start to stop, both included; none where the step leads away."""
    if step == 0:
        raise ValueError("the step is 0")
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("value")) if (stop - start) * step >= 0 else spark.range(0).select(F.col("id").alias("value"))


def values(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A literal row set with columns column1, column2, ..."""
    return spark.createDataFrame(rows, [f"column{i + 1}" for i in range(len(rows[0]))])


def dual(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'X' AS dummy")


def collection(df: DataFrame, array: Column) -> DataFrame:
    """TABLE(collection): a row for each item of an array, as column_value."""
    return df.select(F.explode(array).alias("column_value"))


def import_vectors(spark: SparkSession, path: str, id_column: str, vector_column: str, header: bool = True) -> DataFrame:
    """(id, vector) from a CSV file whose vectors are JSON arrays."""
    rows = spark.read.csv(path, header=header, escape='"')
    return rows.select(F.col(id_column).cast("long").alias("id"), F.from_json(vector_column, "array<float>").alias("vector"))


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).format(kind).save(path)


def load(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A saved table. The schema is given: nothing is inferred by reading all of it."""
    return spark.read.format(kind).schema(schema).load(path)


def columns_of(spark: SparkSession, df: DataFrame) -> DataFrame:
    """table_info: cid, name, type, notnull of a DataFrame's columns."""
    rows = [(i, f.name, f.dataType.simpleString(), int(not f.nullable)) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "cid int, name string, type string, notnull int")


def blob_read(data: Column, offset: int, size: int) -> Column:
    """size bytes of a binary from offset on, counted from 0."""
    return F.substring(data, offset + 1, size)


def key_range(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Rows with low <= key < high; a bound of None is open. The comparison reaches the scan, which skips row groups."""
    out = df if low is None else df.where(F.col(key) >= low)
    return out if high is None else out.where(F.col(key) < high)
