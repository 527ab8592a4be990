"""Small helpers shared by the operators: reading tables, written cuts of lineage, Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that goes to Python. Long texts make a batch large, so it is kept small.
ARROW_ROWS = "1000"
#: Whether a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys that a lookup treats apart: more rows than HOT_ROWS and than a HOT_KEYS-th of all, so HOT_KEYS of them at most.
HOT_ROWS, HOT_KEYS = 1000, 1000
#: Partitions of a shuffle at most; beyond, partitions are larger and must be worked on in parts.
MOST_PARTITIONS = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder, by whatever file system its path names."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that Python workers need little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a local session, as in tests, makes one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set, and a cluster needs a shared folder for written tables")
        folder = getattr(shared_folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="basaltql-")
        shared_folder.own = folder
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again with the schema it had. Tables lie in a folder
    of the application, which `clear` deletes; `forget` deletes one. The write's shuffle files go when it is done."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/basaltql/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(table: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    _delete(table.sparkSession, table.written_to)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; results that read them must have been saved."""
    _delete(spark, f"{shared_folder(spark)}/basaltql/{spark.sparkContext.applicationId}")


def hot_keys(left: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the keys that hold more than HOT_ROWS rows and a HOT_KEYS-th of all of a written table: HOT_KEYS at most."""
    total = left.count()
    if total <= HOT_ROWS:
        return []
    counts = left.groupBy(F.xxhash64(*keys).alias("key")).count().where(F.col("count") > max(HOT_ROWS, total // HOT_KEYS))
    return [r["key"] for r in counts.collect()]


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], hot: list[int], how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once. Rows of the hot keys (hot_keys) aren't moved: what right has of these is
    broadcast, HOT_KEYS rows at most. how: inner or left."""
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), keys, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), keys, how))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of a plan: for a scan, the bytes of its files. 0 if it has none, as for local rows."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Parts that hold bytes_each of df's input, at least the session's shuffle partitions; no upper limit."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // bytes_each))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """As parts_for, MOST_PARTITIONS at most."""
    return min(MOST_PARTITIONS, parts_for(df, bytes_each))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): the columns the operators use, under fixed names. Other columns of docs don't matter.

    Rows with the same doc_id are told apart by text_hash; text_hash of a null text is that of null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most most_bytes of a string column, or one row."""
    for batch in batches:
        lengths = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """As slices, but small batches are put together, too."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column, most_bytes):
        now = pa.compute.sum(pa.compute.binary_length(batch.column(column))).as_py() or 0
        if held and size + now > most_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += now
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
