"""Definitions: changes of a table's columns, views, dictionary views, plans as rows, and functions that users define."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltql.sources import tables

from .cuts import cut


def add(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """ALTER TABLE ADD: a new column that holds the default."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return df.withColumn(name, F.lit(default).cast(kind))


def modify(df: DataFrame, name: str, kind: str) -> DataFrame:
    """ALTER TABLE MODIFY: a value that the new type can't hold stops the query."""
    return df.withColumn(name, F.col(name).cast(kind))


def drop(df: DataFrame, *names: str) -> DataFrame:
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    return df.drop(*names)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def generated(df: DataFrame, name: str, expression: str) -> DataFrame:
    """GENERATED ALWAYS AS: a column that an expression of the others gives."""
    return df.withColumn(name, F.expr(expression))


def view(spark: SparkSession, name: str, source: DataFrame, sql: str) -> DataFrame:
    """CREATE VIEW: the query over {source}, known by name from now on; its rows."""
    spark.sql(sql, source=source).createOrReplaceTempView(name)
    return spark.table(name)


def materialized(df: DataFrame) -> DataFrame:
    """CREATE MATERIALIZED VIEW: the rows as they are now, written once."""
    return cut(df)


def user_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USER_TABLES: table_name and num_columns of each table of a folder."""
    return spark.createDataFrame([(n, len(tables.table(spark, sf_dir, n).columns)) for n in tables.TABLES], "table_name string, num_columns int")


def user_tab_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USER_TAB_COLUMNS: table_name, column_name, data_type, nullable and column_id, from 1, of every table of a folder."""
    rows = [(n, f.name, f.dataType.simpleString(), "Y" if f.nullable else "N", i) for n in tables.TABLES for i, f in enumerate(tables.table(spark, sf_dir, n).schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable string, column_id int")


def explain(df: DataFrame, mode: str = "formatted") -> DataFrame:
    """EXPLAIN: the lines of the plan, numbered."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
    return df.sparkSession.createDataFrame(list(enumerate(text.splitlines())), "line int, plan string")


def with_functions(spark: SparkSession, functions: dict[str, str], sources: dict[str, DataFrame], sql: str) -> DataFrame:
    """WITH FUNCTION: a query that may call SQL functions, given by head (name, parameters and RETURNS) and body. Spark puts
    their bodies into the plan, so they cost what the expressions cost."""
    for name, df in sources.items():
        df.createOrReplaceTempView(name)
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return spark.sql(sql)


def aggregate(each: str, agg: str, result: str = "x") -> Callable[[str | Column], Column]:
    """A user's aggregate from built-in parts, with partial sums before the shuffle: an expression of x for each value, an
    aggregate over them, and an expression of x for the result."""

    def build(column: str | Column) -> Column:
        value = F.col(column) if isinstance(column, str) else column
        apply = lambda text, v: F.transform(F.array(v), lambda x: F.call_function(text.split("(")[0], x) if text != "x" else x)[0]
        return apply(result, F.call_function(agg, apply(each, value)))

    return build
