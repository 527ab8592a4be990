"""Changes to tables as functions from DataFrames to DataFrames: merge, upsert, update, delete, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut


def merge(target: DataFrame, source: DataFrame, key: str, update: dict[str, Column] | None = None, delete: Column | None = None, insert: bool = True) -> DataFrame:
    """MERGE INTO target USING source: matched rows are updated, or deleted where delete holds after it; others inserted.

    Expressions name the sides as t.column and s.column. One full outer join."""
    t, s = target.alias("t"), source.alias("s")
    both = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    old, new = F.col(f"t.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()
    own = set(source.columns)
    columns = [F.when(old & new, (update or {}).get(c, F.col(f"t.{c}"))).when(old, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}") if c in own else F.lit(None)).alias(c) for c in target.columns]
    gone = F.coalesce(delete, F.lit(False)) & old & new if delete is not None else F.lit(False)
    return both.where((old | F.lit(insert)) & ~gone).select(*columns)


def once(rows: DataFrame, key: str, order: str | None = None, last: bool = False) -> DataFrame:
    """One row of each key: the first by order (the rows' own order without one), or the last. Null keys stay."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    held = rows.withColumn("__place", place).withColumn("__row", F.struct(*rows.columns))
    pick = F.max_by if last else F.min_by
    one = held.where(F.col(key).isNotNull()).groupBy(key).agg(pick("__row", "__place").alias("__row")).select("__row.*")
    return one.unionByName(rows.where(F.col(key).isNull()))


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """INSERT OR IGNORE: new keys only; of rows with one key the first goes in."""
    return target.unionByName(once(rows, key, order).join(target, key, "left_anti").select(*target.columns))


def replace_into(target: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """REPLACE INTO: rows take the place of those with their key; of rows with one key the last goes in."""
    new = once(rows, key, order, last=True)
    return target.join(new, key, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def first_hits(df: DataFrame, hit: Column, key: str, order: list[str | Column], limit: int) -> DataFrame:
    """(key) of the first rows by order where the condition holds: a top-k, not a global window."""
    return df.where(hit).orderBy(*order, key).limit(limit).select(F.col(key).alias("__hit"))


def update(df: DataFrame, where: Column, values: dict[str, Column], key: str | None = None, order: list[str | Column] | None = None, limit: int | None = None) -> DataFrame:
    """Rows where the condition holds get the values; with a limit, only the first by order, told by their key."""
    hit = F.coalesce(where, F.lit(False))
    if limit is not None:
        chosen = first_hits(df, hit, key, order or [], limit)
        df = df.join(F.broadcast(chosen) if limit <= 100_000 else chosen, F.col(key) == F.col("__hit"), "left")
        hit = F.col("__hit").isNotNull()
    return df.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns if c != "__hit"))


def delete(df: DataFrame, where: Column, key: str | None = None, order: list[str | Column] | None = None, limit: int | None = None) -> DataFrame:
    """The rows where the condition doesn't hold; with a limit, only the first by order go, told by their key."""
    hit = F.coalesce(where, F.lit(False))
    if limit is None:
        return df.where(~hit)
    return df.join(first_hits(df, hit, key, order or [], limit), F.col(key) == F.col("__hit"), "left_anti")


def truncate(df: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return df.limit(0)


def check_violations(df: DataFrame, checks: dict[str, Column], key: list[str] | None = None) -> DataFrame:
    """df's rows with the names of the CHECK conditions that are false there (null passes), and of key columns that are null."""
    failed = [F.when(~c, F.lit(n)) for n, c in checks.items()] + [F.when(F.col(k).isNull(), F.lit(f"{k} is null")) for k in key or []]
    return df.withColumn("violations", F.array_compact(F.array(*failed))).where(F.size("violations") > 0)


def violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand in more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def changeset(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, op, before, after): inserts, deletes and updates that lead from old to new."""
    pack = lambda df, name: df.select(F.col(key), F.struct(*df.columns).alias(name))
    both = pack(old, "before").join(pack(new, "after"), key, "full")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, op.alias("op"), "before", "after")


def upsert(target: DataFrame, rows: DataFrame, key: str, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE: a row whose key is there gives the old row values, where the condition holds. t and s name the sides."""
    keep = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return merge(target, rows, key, {c: F.when(keep, v).otherwise(F.col(f"t.{c}")) for c, v in values.items()})


def update_from(target: DataFrame, source: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... FROM: rows with a match get the values, others stay. The source holds a key once."""
    both = target.alias("t").join(source.alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "left")
    return both.select(*(F.when(F.col(f"s.{key}").isNotNull(), values[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}") for c in target.columns))


def insert_all(rows: DataFrame, branches: dict[str, Column], first: bool = False, otherwise: str | None = None) -> dict[str, DataFrame]:
    """INSERT ALL or FIRST: the rows that go to each named target; `otherwise` takes those that meet no condition."""
    out, met = {}, F.lit(False)
    for name, condition in branches.items():
        holds = F.coalesce(condition, F.lit(False))
        out[name] = rows.where(holds & ~met if first else holds)
        met = met | holds
    if otherwise is not None:
        out[otherwise] = rows.where(~met)
    return out


def returning(df: DataFrame, where: Column, columns: list[Column]) -> DataFrame:
    """RETURNING: a projection of the rows that a change meets."""
    return df.where(F.coalesce(where, F.lit(False))).select(*columns)


def next_values(df: DataFrame, order: list[str | Column], name: str = "nextval", start: int = 1, step: int = 1) -> DataFrame:
    """A sequence's values along the order. Partitions are sorted by range and counted, so no task holds all rows; the sorted
    rows are written with their places, so that both uses see the same ones."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = cut(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", at))
    #: One row for each partition.
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__rows")).withColumn("__before", F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows"))
    return ordered.join(F.broadcast(counts), "__part").withColumn(name, (F.col("__before") + F.col("__at")) * step + start).drop("__part", "__at", "__rows", "__before")


class Sequence:
    """CREATE SEQUENCE: values from start by step within least and most; beyond them it begins anew (cycle) or fails."""

    def __init__(self, start: int = 1, step: int = 1, least: int | None = None, most: int | None = None, cycle: bool = False):
        self.start, self.step, self.cycle = start, step, cycle
        self.least, self.most = (1 if step > 0 else -(2**63)) if least is None else least, (2**63 - 1 if step > 0 else -1) if most is None else most
        self.given = 0

    def value(self, n: Column | int) -> Column:
        """The n-th value, from 0."""
        n = n if isinstance(n, Column) else F.lit(n)
        plain = n * self.step + self.start
        if not self.cycle:
            outside = (plain < self.least) | (plain > self.most)
            return F.when(outside, F.raise_error(F.lit("the sequence is exhausted")).cast("long")).otherwise(plain)
        first, span = (self.least, (self.most - self.least) // self.step + 1) if self.step > 0 else (self.most, (self.most - self.least) // -self.step + 1)
        before = (self.most - self.start) // self.step + 1 if self.step > 0 else (self.start - self.least) // -self.step + 1
        return F.when(n < before, plain).otherwise(F.pmod(n - before, F.lit(span)) * self.step + first)

    def nextval(self, df: DataFrame, order: list[str | Column], name: str = "nextval") -> DataFrame:
        """df with the next value for each row, along the order."""
        out = next_values(df, order, "__n", self.given).withColumn(name, self.value(F.col("__n")).cast("long")).drop("__n")
        self.given += df.count()
        return out

    def currval(self) -> Column:
        """The last value that was given."""
        if not self.given:
            raise ValueError("the sequence has given no value yet")
        return self.value(self.given - 1)


def apply_log(base: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """The table after a change log (lsn, op, after): each key's last entry wins; op 'delete' removes the row."""
    last = log.groupBy(key).agg(F.max_by(F.struct("op", "after"), "lsn").alias("__last"))
    rows = last.where(F.col("__last.op") != "delete").select("__last.after.*")
    return base.join(last.select(key), key, "left_anti").unionByName(rows)
