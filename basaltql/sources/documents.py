"""Rows out of documents: JSON_TABLE and XMLTABLE."""

from __future__ import annotations

import dataclasses
import json
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass
class Field:
    """A column of JSON_TABLE: a path's value as a type, its default, the row's number, or whether the path is there."""

    name: str
    type: str = "string"
    path: str | None = None
    default: object = None
    ordinality: bool = False
    exists: bool = False


@dataclasses.dataclass
class Nested:
    """NESTED PATH: the items below a row; a row without items stays, with nulls."""

    path: str
    columns: list[Field | Nested]


def _items(text, path: str):
    """The JSON texts of the items at a path: those of an array, or the one value."""
    inner = F.get_json_object(text, path.removesuffix("[*]"))
    return F.when(F.startswith(F.ltrim(inner), F.lit("[")), F.from_json(inner, "array<string>")).when(inner.isNotNull(), F.array(inner))


def json_table(df: DataFrame, source: str, path: str, columns: list[Field | Nested]) -> DataFrame:
    """df's rows beside the rows that JSON_TABLE makes of the document in source. Rows without items go."""
    return _unfold(df, F.col(source), path, columns, "__json0", outer=False).drop("__json0")


def _unfold(df: DataFrame, text, path: str, columns: list[Field | Nested], at: str, outer: bool) -> DataFrame:
    unfold = F.posexplode_outer if outer else F.posexplode
    out = df.select("*", unfold(_items(text, path)).alias(f"{at}_n", at))
    for c in columns:
        if isinstance(c, Nested):
            continue
        found = F.get_json_object(at, c.path or f"$.{c.name}")
        if c.ordinality:
            value = F.col(f"{at}_n") + 1
        elif c.exists:
            value = F.when(F.col(at).isNotNull(), found.isNotNull().cast("int"))
        else:
            value = found.try_cast(c.type)
            value = value if c.default is None else F.when(F.col(at).isNotNull(), F.coalesce(value, F.lit(c.default).cast(c.type)))
        out = out.withColumn(c.name, value)
    for i, c in enumerate(columns):
        if isinstance(c, Nested):
            below = f"{at}_{i}"
            out = _unfold(out, F.col(at), c.path, c.columns, below, outer=True).drop(below)
    return out.drop(f"{at}_n")


def xmltable(df: DataFrame, source: str, path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """df's rows beside one for each element at the path, such as /list/item: name to (child path or @attribute, type).

    Spark's own xpath gives an array for each path and so loses which element lacks a child; an Arrow UDF keeps rows whole."""
    wanted = {name: p for name, (p, _) in columns.items()}
    root, *rest = path.strip("/").split("/")

    def rows(text: str | None) -> str | None:
        try:
            top = ET.fromstring(text) if text else None
        except ET.ParseError:
            return None
        if top is None or top.tag != root:
            return None
        found = top.findall("/".join(rest)) if rest else [top]
        return json.dumps([{n: e.get(p[1:]) if p.startswith("@") else e.text if p == "." else e.findtext(p) for n, p in wanted.items()} for e in found])

    @F.pandas_udf("string")
    def unfold(s: pd.Series) -> pd.Series:
        return s.map(rows)

    items = F.from_json(unfold(F.col(source)), "array<struct<" + ",".join(f"`{n}`:string" for n in columns) + ">>")
    return df.withColumn("__item", F.explode(items)).select("*", *(F.col(f"__item.`{n}`").try_cast(t).alias(n) for n, (_, t) in columns.items())).drop("__item")
