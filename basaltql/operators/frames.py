"""Window frames and limits that Spark SQL has no syntax for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut


def groups_frame(df: DataFrame, partition: list[str], order: str, start: int, end: int, agg: Column, name: str) -> DataFrame:
    """agg over a GROUPS frame: from start to end peer groups away. Peers are numbered, then a RANGE frame runs on the number."""
    peers = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    frame = Window.partitionBy(*partition).orderBy("__peer").rangeBetween(start, end)
    return peers.withColumn(name, agg.over(frame)).drop("__peer")


def excluding(df: DataFrame, partition: list[str], order: list[str | Column], value: str, agg: str, exclude: str, name: str, start: int = Window.unboundedPreceding, end: int = Window.unboundedFollowing) -> DataFrame:
    """sum, count, avg, min or max of value over ROWS start..end without the current row, its peer group ('group') or its other
    peers ('ties'). Null if nothing is left, or 0 for count.

    Peers are neighbours, so the same frame over the peers alone holds just the peers inside the frame: sums and counts are
    differences of windows. min and max need the rows themselves, of a frame with two bounds; without bounds they are taken
    over the groups before and after."""
    rows = Window.partitionBy(*partition).orderBy(*order)
    held = df.withColumn("__peer", F.dense_rank().over(rows)).withColumn("__row", F.row_number().over(rows))
    #: One order for both windows, also among peers.
    turned = start > Window.unboundedPreceding and end == Window.unboundedFollowing
    place, frame = (F.desc("__row"), (Window.unboundedPreceding, -start)) if turned else (F.asc("__row"), (start, end))
    whole = Window.partitionBy(*partition).orderBy(place).rowsBetween(*frame)
    peers = Window.partitionBy(*partition, "__peer").orderBy(place).rowsBetween(*frame)
    inside = start <= 0 <= end
    if agg in ("sum", "count", "avg"):
        own = F.col(value) if inside else F.lit(None)

        def left(f) -> Column:
            zero = lambda c: F.coalesce(c, F.lit(0))
            alone = zero(F.when(own.isNotNull(), F.lit(1) if f is F.count else own))
            gone = {"current row": alone, "group": zero(f(value).over(peers)), "ties": zero(f(value).over(peers)) - alone}[exclude]
            return zero(f(value).over(whole)) - gone

        n = left(F.count)
        out = n if agg == "count" else F.when(n > 0, left(F.sum) if agg == "sum" else left(F.sum) / n)
    elif start > Window.unboundedPreceding and end < Window.unboundedFollowing:
        items = F.collect_list(F.struct(F.col(value).alias("v"), "__peer", "__row")).over(whole)
        keep = {"current row": lambda x: x["__row"] != F.col("__row"), "group": lambda x: x["__peer"] != F.col("__peer"), "ties": lambda x: (x["__peer"] != F.col("__peer")) | (x["__row"] == F.col("__row"))}[exclude]
        values = F.transform(F.filter(items, keep), lambda x: x["v"])
        out = F.array_min(values) if agg == "min" else F.array_max(values)
    elif start == Window.unboundedPreceding and end == Window.unboundedFollowing:
        f, both = (F.min, F.least) if agg == "min" else (F.max, F.greatest)
        at = "__row" if exclude == "current row" else "__peer"
        #: A frame without an end is worked out anew for each row, so the rows after are those before in the reverse order.
        before = lambda place: f(value).over(Window.partitionBy(*partition).orderBy(place).rangeBetween(Window.unboundedPreceding, -1))
        out = both(before(F.asc(at)), before(F.desc(at)))
        out = both(out, F.col(value)) if exclude == "ties" else out
    else:
        raise ValueError("min and max with EXCLUDE need a frame with two bounds or none")
    return held.withColumn(name, out).drop("__peer", "__row")


def count_greater(df: DataFrame, group: str, value: str, others: DataFrame, other_group: str, other_value: str, name: str) -> DataFrame:
    """df with the number of the others in the row's group whose value is greater; 0 beside nulls. No pairs are made: the
    different values of both sides are sorted by ranges, counted along a range, and the ranges before it added."""
    point = lambda rows, g, v, n: rows.select(F.col(g).alias("__g"), F.col(v).alias("__v"), F.lit(n).alias("__n")).where("__g is not null and __v is not null")
    points = point(df, group, value, 0).unionByName(point(others, other_group, other_value, 1)).groupBy("__g", "__v").agg(F.sum("__n").alias("__n"), (F.min("__n") == 0).alias("__asked"))
    ordered = cut(points.orderBy("__g", F.desc("__v")).withColumn("__part", F.spark_partition_id()))
    ahead = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ordered.groupBy("__g", "__part").agg(F.sum("__n").alias("__n")).select("__g", "__part", ahead(Window.partitionBy("__g").orderBy("__part")).alias("__before"))
    within = ordered.withColumn("__within", ahead(Window.partitionBy("__g", "__part").orderBy(F.desc("__v")))).where("__asked")
    counts = within.join(ranges, ["__g", "__part"]).select("__g", "__v", (F.col("__before") + F.col("__within")).alias("__count"))
    out = df.join(counts, (F.col(group) == F.col("__g")) & (F.col(value) == F.col("__v")), "left")
    return out.select(*df.columns, F.coalesce("__count", F.lit(0).cast("long")).alias(name))


def ratio_to_report(value: str, partition: list[str]) -> Column:
    return F.try_divide(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy(*partition)))


def fetch_percent(df: DataFrame, order: list[Column], percent: float) -> DataFrame:
    """The first ceil(percent % of all) rows. The number is counted first, then Spark takes a top-k: no global window."""
    n = df.count()
    return df.orderBy(*order).limit(-(-int(n * percent * 1000) // 100_000))


def fetch_ties(df: DataFrame, order: list[tuple[str, bool]], n: int) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES: the first n rows by (column, descending) and all that equal the last of them. The last
    one's keys are looked up by a top-k; nulls come first ascending and last descending, as Spark sorts."""
    by = [F.desc(c) if down else F.asc(c) for c, down in order]
    top = df.orderBy(*by).limit(n).select(*(F.col(c).alias(f"__last_{c}") for c, _ in order))
    last = top.orderBy(*(F.asc(f"__last_{c}") if down else F.desc(f"__last_{c}") for c, down in order)).limit(1)
    before, same = F.lit(False), F.lit(True)
    for c, down in order:
        x, y = F.col(c), F.col(f"__last_{c}")
        ahead = (x > y) | (x.isNotNull() & y.isNull()) if down else (x < y) | (x.isNull() & y.isNotNull())
        before, same = before | (same & F.coalesce(ahead, F.lit(False))), same & x.eqNullSafe(y)
    return df.join(F.broadcast(last), before | same, "inner").select(*df.columns)


def rownum(df: DataFrame, n: int, order: list[Column] | None = None, name: str = "rownum") -> DataFrame:
    """WHERE ROWNUM <= n: n rows, numbered; in the given order if there is one."""
    rows = (df.orderBy(*order) if order else df).limit(n)
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*(order or [F.monotonically_increasing_id()]))))


def keep_dense_rank(df: DataFrame, group: list[str], order: Column, aggs: list[Column]) -> DataFrame:
    """Aggregates over the rows of each group that rank first: KEEP (DENSE_RANK FIRST ORDER BY order). For LAST, give the
    reverse order."""
    ranked = df.withColumn("__rank", F.rank().over(Window.partitionBy(*group).orderBy(order)))
    return ranked.where("__rank = 1").groupBy(*group).agg(*aggs)


def corr_or_null(x: str, y: str) -> Column:
    """Correlation of the rows with both values; null where a column is constant. Extremes tell that: variances of parts that are
    put together have rounding errors."""
    both = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a))
    u, v = both(x, y), both(y, x)
    varied = (F.min(u) < F.max(u)) & (F.min(v) < F.max(v))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(u) * F.var_pop(v))))


def unpivot(df: DataFrame, columns: list[str], name: str, value: str, nulls: bool = False) -> DataFrame:
    """A row for each of the columns, beside all original ones."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns)))
    out = df.withColumn("__pair", pairs).select("*", f"__pair.{name}", f"__pair.{value}").drop("__pair")
    return out if nulls else out.where(F.col(value).isNotNull())


def nth_from_last(value: str, n: int, partition: list[str], order: list[Column]) -> Column:
    """NTH_VALUE(n) FROM LAST over the whole partition; order is the reverse of the window's own."""
    return F.nth_value(value, n).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def pivot_xml(df: DataFrame, group: list[str], name: str = "pivot_xml") -> DataFrame:
    """PIVOT XML: a row for each group with an empty set of pivoted values."""
    return df.select(*group).distinct().withColumn(name, F.lit("<PivotSet></PivotSet>"))


def json_group_object(key: str, value: str) -> Column:
    """An object of a group's keys and values in the keys' order; nulls are written."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))
    member = lambda p: F.concat(F.to_json(F.array(p["k"])).substr(F.lit(2), F.length(F.to_json(F.array(p["k"]))) - 2), F.lit(":"), F.coalesce(F.regexp_extract(F.to_json(F.array(p["v"])), r"(?s)^\[(.*)\]$", 1), F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, member), ","), F.lit("}"))


def json_group_array(value: str, order: str | None = None, absent_on_null: bool = False) -> Column:
    """JSON_GROUP_ARRAY: a group's values as a JSON array, by order; nulls are written unless they are to be absent."""
    items = F.collect_list(F.struct(F.col(order or value).alias("k"), F.struct(F.col(value).alias("v")).alias("x")))
    texts = F.transform(F.sort_array(items), lambda i: F.coalesce(F.regexp_extract(F.to_json(F.array(i["x"]["v"])), r"(?s)^\[(.*)\]$", 1), F.lit("null")))
    kept = F.filter(texts, lambda s: s != "null") if absent_on_null else texts
    return F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]"))
