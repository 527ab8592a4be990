"""Hierarchical queries and row patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .changes import next_values
from .cuts import cut

#: Written levels of a hierarchy that are put together; so are as many of the parts that come out.
PART_LEVELS = 8


def _put_together(parts: list[list[DataFrame]], new: DataFrame) -> None:
    """Adds a written table to parts: those of one level, of PART_LEVELS levels, and so on, so that few are left to unite."""
    for i in range(len(parts) + 1):
        if i == len(parts):
            parts.append([])
        parts[i].append(new)
        if len(parts[i]) < PART_LEVELS:
            return
        new = cut(reduce(DataFrame.unionByName, parts[i]))
        parts[i] = []


def connect_by(df: DataFrame, key: str, parent: str, start: Column, label: str | None = None, siblings: str | None = None) -> DataFrame:
    """START WITH start CONNECT BY NOCYCLE PRIOR key = parent: df's columns, level, root, path, is_leaf, is_cycle.

    siblings (ORDER SIBLINGS BY, or SEARCH): adds `__place`, the values of that column from the root down; `depth_first` and
    `breadth_first` number the rows by it.

    One join a level, so as many rounds as the hierarchy is deep; a path that would meet itself ends there. Each level is
    written, which cuts its lineage."""
    label = label or key
    row = df.withColumn("level", F.lit(1)).withColumn("root", F.col(key)).withColumn("__seen", F.array(key)).withColumn("path", F.concat(F.lit("/"), F.col(label).cast("string"))).withColumn("__place", F.array(siblings or F.lit(0))).where(start)
    parents = df.select(F.col(parent).alias("__p")).where("__p is not null").distinct()
    parts: list[list[DataFrame]] = [[row]]
    level, n = row, 1
    while True:
        n += 1
        up = level.select(F.col(key).alias("__up"), "root", "__seen", F.col("path").alias("__path"), F.col("__place").alias("__above"))
        level = df.join(up, F.col(parent) == F.col("__up")).where(~F.array_contains("__seen", F.col(key)))
        level = level.select(*df.columns, F.lit(n).alias("level"), "root", F.concat("__seen", F.array(F.col(key))).alias("__seen"), F.concat("__path", F.lit("/"), F.col(label).cast("string")).alias("path"), (F.concat("__above", F.array(siblings)) if siblings else F.col("__above")).alias("__place"))
        level = cut(level)
        if level.isEmpty():
            break
        _put_together(parts, level)
    out = reduce(DataFrame.unionByName, [p for some in parts for p in some])
    nexts = df.select(F.col(parent).alias("__p"), F.col(key).alias("__k"))
    cycles = out.join(nexts, F.col(key) == F.col("__p")).where(F.array_contains("__seen", F.col("__k"))).select("path", F.lit(1).alias("is_cycle")).distinct()
    return out.join(parents, F.col(key) == F.col("__p"), "left").join(cycles, "path", "left").select(*df.columns, "level", "root", "path", F.col("__p").isNull().cast("int").alias("is_leaf"), F.coalesce("is_cycle", F.lit(0)).alias("is_cycle"), *(["__place"] if siblings else []))


def depth_first(rows: DataFrame, name: str = "place") -> DataFrame:
    """SEARCH DEPTH FIRST: rows of connect_by with siblings, numbered parents first, each followed by what is below it."""
    return next_values(rows, ["root", "__place", "path"], name).drop("__place")


def breadth_first(rows: DataFrame, name: str = "place") -> DataFrame:
    """SEARCH BREADTH FIRST: numbered level by level."""
    return next_values(rows, ["level", "root", "__place", "path"], name).drop("__place")


#: What a pattern is made of: variables, groups, alternatives and quantifiers.
_PART = re.compile(r"\s*(?:([A-Za-z_]\w*)|(\()|(\))|(\|)|([+*?]\??|\{\d*,?\d*\}\??))\s*")


def _regular(pattern: str, letters: dict[str, str]) -> str:
    """A row pattern as a regular expression over the variables' letters."""
    out, at = "", 0
    while at < len(pattern):
        part = _PART.match(pattern, at)
        if not part or (part[1] and part[1] not in letters):
            raise ValueError(f"row pattern not understood at {pattern[at:]!r}")
        out += letters[part[1]] if part[1] else "(?:" if part[2] else part[3] or part[4] or part[5]
        at = part.end()
    return out


def _matches(df: DataFrame, partition: list[str], order: list[str], define: dict[str, Column], pattern: str, carried: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """A row for each match: the partition's columns, match_number and __match, its rows with their letters."""
    #: Letters of the private use area: there are more of them than variables.
    letters = {v: chr(0xE001 + i) for i, v in enumerate(define)}
    java = _regular(pattern, letters)
    letter = F.lit(chr(0xE000))
    for v, c in reversed(define.items()):
        letter = F.when(c, F.lit(letters[v])).otherwise(letter)
    rows = df.withColumn("__l", letter).groupBy(*partition).agg(F.sort_array(F.collect_list(F.struct(*order, "__l", *(F.col(c).alias(f"__m_{c}") for c in carried)))).alias("__rows"))
    text = F.array_join(F.transform("__rows", lambda r: r["__l"]), "")
    #: Marks around each match, also an empty one; what lies between marks tells where matches start.
    begin, end = chr(0xF000), chr(0xF001)
    marked = F.split(F.regexp_replace(text, F.lit(f"({java})"), F.lit(f"{begin}$1{end}")), begin)
    none = F.struct(F.length(marked[0]).alias("at"), F.array().cast("array<struct<s:int,n:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        n, after = F.length(F.substring_index(x, end, 1)), F.length(x) - 1
        return F.struct((a["at"] + after).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), n.alias("n")))).alias("out"))

    spans = F.aggregate(F.slice(marked, F.lit(2), F.size(marked)), none, step, lambda a: F.filter(a["out"], lambda x: x["n"] > 0))
    hits = rows.withColumn("__spans", spans).select(*partition, "__rows", F.posexplode("__spans").alias("__n", "__span"))
    return hits.select(*partition, (F.col("__n") + 1).alias("match_number"), F.slice("__rows", F.col("__span.s") + 1, F.col("__span.n")).alias("__match")), letters


def match_recognize(df: DataFrame, partition: list[str], order: list[str], define: dict[str, Column], pattern: str, measures: dict[str, tuple[str, str, str]]) -> DataFrame:
    """ONE ROW PER MATCH of a pattern such as `A (B | C)+ D?` over the ordered rows of each partition.

    define: the condition of each variable, tested in this order; it may use window functions over the rows. measures: name
    to (variable, column, 'first' | 'last' | 'count'). Rows become letters, a partition's letters a string, and a regular
    expression finds the matches in it; a partition's rows are together in one row, as the operator requires. A match has a
    row at least. A pattern with anything but variables, groups, alternatives and quantifiers is an error."""
    used = sorted({c for _, c, k in measures.values() if k != "count"})
    hits, letters = _matches(df, partition, order, define, pattern, used)
    own = lambda v: F.filter("__match", lambda r: r["__l"] == letters[v])
    out = [(F.size(own(v)).cast("long") if k == "count" else F.try_element_at(own(v), F.lit(1 if k == "first" else -1))[f"__m_{c}"]).alias(n) for n, (v, c, k) in measures.items()]
    return hits.select(*partition, "match_number", *out)


def match_rows(df: DataFrame, partition: list[str], order: list[str], define: dict[str, Column], pattern: str, columns: list[str]) -> DataFrame:
    """ALL ROWS PER MATCH: the matched rows' columns with match_number, row_in_match and classifier, the variable a row is."""
    hits, letters = _matches(df, partition, order, define, pattern, columns)
    names = F.create_map(*(F.lit(x) for v, c in letters.items() for x in (c, v)))
    rows = hits.select(*partition, "match_number", F.posexplode("__match").alias("__at", "__row"))
    return rows.select(*partition, "match_number", (F.col("__at") + 1).alias("row_in_match"), names[F.col("__row.__l")].alias("classifier"), *(F.col(f"__row.__m_{c}").alias(c) for c in columns))


def level_rows(spark: SparkSession, n: int) -> DataFrame:
    """CONNECT BY LEVEL <= n: a row for each level from 1 to n; one at least."""
    return spark.range(1, max(n, 1) + 1).select(F.col("id").cast("int").alias("level"))


def recursive_distinct(anchor: DataFrame, step, most_rounds: int = 64) -> DataFrame:
    """WITH RECURSIVE ... UNION: step(new rows) until nothing new comes. A round reads only what the last one added."""
    seen = new = anchor.distinct()
    for _ in range(most_rounds):
        new = step(new).distinct().subtract(seen)
        if new.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(new)
    raise ValueError(f"the recursion still adds rows after {most_rounds} rounds")
