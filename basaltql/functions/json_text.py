"""JSON functions that change or describe a document. Built-in functions can't express edits at a path, so these run as Arrow
UDFs over text, a batch at a time; reading functions stay in scalar.py as Spark's own."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from basaltql.functions.scalar import _literal, named

_STEP = re.compile(r'\.(?:"([^"]*)"|([^.\[]+))|\[(\d+)\]')


class _BAD:
    """Stands for a missing value, or a text that is no JSON."""



def steps(path: str) -> list[str | int]:
    """`$.a."b c"[0]` as ["a", "b c", 0]."""
    return [int(i) if i else quoted or plain for quoted, plain, i in _STEP.findall(path)]


def loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return _BAD


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _walk(value, keys: list[str | int]):
    """The value at the keys, or _BAD where there is none."""
    for k in keys:
        if isinstance(value, dict) and isinstance(k, str) and k in value or isinstance(value, list) and isinstance(k, int) and k < len(value):
            value = value[k]
        else:
            return _BAD
    return value


def updated(node, path: list[str | int], change):
    """node with change(value) in place of the value at the path. change gets _BAD where a member is missing, and what it
    gives as _BAD is left out. Nothing is made on the way to a parent that isn't there."""
    if not path:
        return change(node)
    key, rest = path[0], path[1:]
    if isinstance(node, dict) and isinstance(key, str):
        members = {**node, key: updated(node.get(key, _BAD), rest, change)}
        return {k: v for k, v in members.items() if v is not _BAD}
    if isinstance(node, list) and isinstance(key, int):
        old = node[key] if key < len(node) else _BAD
        new = updated(old, rest, change)
        return [*node[:key], *(v for v in (new,) if v is not _BAD), *node[key + 1 :]]
    return node


def _new_value(held: str):
    """The value of an argument; a text that is an object or array counts as that."""
    value = json.loads(held).get("v")
    if isinstance(value, str) and value.lstrip().startswith(("{", "[")):
        inner = loads(value)
        return value if inner is _BAD else inner
    return value


#: What each function puts in the place of an old value (or of none).
CHANGES = {"SET": lambda old, new: new, "INSERT": lambda old, new: new if old is _BAD else old, "REPLACE": lambda old, new: _BAD if old is _BAD else new}


def _changed(text: str, rest: list[str], how) -> str | None:
    node = loads(text)
    for path, held in zip(rest[::2], rest[1::2], strict=True):
        if node is not _BAD and path is not None:
            value = _new_value(held)
            node = updated(node, steps(path), lambda old, value=value: how(old, value))
    return None if node is _BAD else dumps(node)


def _remove(text: str, rest: list[str]) -> str | None:
    node = loads(text)
    for path in rest:
        if node is not _BAD and path is not None:
            node = updated(node, steps(path), lambda old: _BAD)
    return None if node is _BAD else dumps(node)


def merge_patch(target, patch):
    """RFC 7396: members of an object patch replace, null removes, anything else takes the target's place."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def _patch(text: str, rest: list[str]) -> str | None:
    target, patch = loads(text), loads(rest[0]) if rest[0] is not None else _BAD
    return None if target is _BAD or patch is _BAD else dumps(merge_patch(target, patch))


def _type(text: str, rest: list[str]) -> str | None:
    value = loads(text)
    if value is not _BAD and rest:
        value = _walk(value, steps(rest[0])) if rest[0] is not None else _BAD
        value = _BAD if value is None else value
    if value is _BAD:
        return None
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return {int: "integer", float: "real", str: "text", list: "array", dict: "object"}[type(value)]


def _pretty(text: str, rest: list[str]) -> str | None:
    value = loads(text)
    return None if value is _BAD else json.dumps(value, ensure_ascii=False, indent=rest[0] if rest and rest[0] is not None else "  ")


def _position(text: str, rest: list[str]) -> str:
    try:
        json.loads(text)
        return "0"
    except json.JSONDecodeError as e:
        return str(e.pos + 1)


def _tree(text: str, rest: list[str]) -> str | None:
    """Every value of a document, parents first: key, value, type, path of its parent, depth."""
    root, out = loads(text), []
    todo = [] if root is _BAD else [(None, root, "$", 0)]
    while todo:
        key, value, path, depth = todo.pop()
        kind = _type(dumps(value), [])
        out.append({"key": None if key is None else str(key), "value": None if value is None else value if isinstance(value, str) else dumps(value), "type": kind, "fullkey": path, "depth": depth})
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        todo += [(k, v, f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", depth + 1) for k, v in items][::-1]
    return dumps(out)


def over_texts(f: Callable[[str, list], str | None], *args: Column) -> Column:
    """f(first, rest) for every row whose first argument isn't null, as a string."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or r[0] is None else f(r[0], list(r[1:])) for r in rows], dtype=object)

    return run(F.array(*(a.cast("string") for a in args)))


def _value(v: Column) -> Column:
    """A value with its type, as JSON text: null stays an absent member."""
    return F.to_json(F.struct(v.alias("v")))


def _mutation(how):
    def run(doc: Column, *rest: Column) -> Column:
        if len(rest) % 2:
            raise ValueError("paths and values come in pairs")
        return over_texts(lambda text, more: _changed(text, more, how), doc, *(_value(a) if i % 2 else a for i, a in enumerate(rest)))

    return run


for _name, _how in CHANGES.items():
    named(f"JSON_{_name}", f"JSONB_{_name}")(_mutation(_how))


@named("JSON_REMOVE", "JSONB_REMOVE")
def json_remove(doc: Column, *paths: Column) -> Column:
    return over_texts(_remove, doc, *paths)


@named("JSON_PATCH", "JSONB_PATCH", "JSON_MERGEPATCH")
def json_patch(doc: Column, patch: Column) -> Column:
    return over_texts(_patch, doc, patch)


@named("JSON_TYPE", "JSONB_TYPE")
def json_type(doc: Column, *path: Column) -> Column:
    return over_texts(_type, doc, *path)


@named("JSON_PRETTY")
def json_pretty(doc: Column, *indent: Column) -> Column:
    return over_texts(_pretty, doc, *indent)


@named("JSON_ERROR_POSITION")
def json_error_position(doc: Column) -> Column:
    """0 for valid JSON, else the place of the first error, counted from 1."""
    return over_texts(_position, doc).cast("int")


@named("JSON_QUOTE", "JSONB_QUOTE")
def json_quote(x: Column) -> Column:
    """A value as a JSON literal; null is the text null."""
    return F.when(x.isNull(), "null").otherwise(F.regexp_extract(_value(x), r'(?s)^\{"v":(.*)\}$', 1))


@named("JSON_OBJECT", "JSONB_OBJECT")
def json_object(*pairs: Column, absent_on_null: bool = False) -> Column:
    """An object of keys and values in turn. Keys are literals; a null value is written as null unless it is to be absent."""
    if len(pairs) % 2:
        raise ValueError("keys and values come in pairs")
    members = [F.when(v.isNull(), F.lit(None).cast("string") if absent_on_null else F.concat(json_quote(k), F.lit(":null"))).otherwise(F.concat(json_quote(k), F.lit(":"), json_quote(v))) for k, v in zip(pairs[::2], pairs[1::2], strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


@named("JSON_ARRAY", "JSONB_ARRAY")
def json_array(*a: Column) -> Column:
    """An array of values of any types; nulls are left out."""
    return F.concat(F.lit("["), F.concat_ws(",", *(F.when(x.isNotNull(), json_quote(x)) for x in a)), F.lit("]"))


def _part(doc: Column, path: Column | str) -> Column:
    """The value at a path as JSON text, by Spark's variants; null if there is none."""
    text = _literal(path) if isinstance(path, Column) else path
    keys = "".join(f"[{k}]" if isinstance(k, int) else '["' + k.replace('"', '\\"') + '"]' for k in steps(text))
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), "$" + keys, "variant"))


def _plain(part: Column) -> Column:
    """A scalar's value, or the JSON text of an object or array; null for JSON's null."""
    return F.get_json_object(F.concat(F.lit('{"v":'), part, F.lit("}")), "$.v")


@named("JSON_EXTRACT", "JSONB_EXTRACT")
def json_extract(doc: Column, *paths: Column | str) -> Column:
    """One path: the value there; more: a JSON array of the values, null where there is none."""
    if len(paths) == 1:
        return _plain(_part(doc, paths[0]))
    parts = F.concat_ws(",", *(F.coalesce(_part(doc, p), F.lit("null")) for p in paths))
    return F.when(F.try_parse_json(doc).isNotNull(), F.concat(F.lit("["), parts, F.lit("]")))


def _arrow_path(key: Column | str | int) -> str:
    """A path, or a key or index of its own."""
    text = _literal(key) if isinstance(key, Column) else str(key)
    return text if text.startswith("$") else f"$[{text}]" if text.isdigit() else f'$."{text}"'


@named("->")
def arrow(doc: Column, key: Column | str | int) -> Column:
    """The value at a key, index or path as JSON text."""
    return _part(doc, _arrow_path(key))


@named("->>")
def long_arrow(doc: Column, key: Column | str | int) -> Column:
    return _plain(_part(doc, _arrow_path(key)))


def _is_tree(part: Column) -> Column:
    return part.startswith("{") | part.startswith("[")


@named("JSON_VALUE")
def json_value(doc: Column, path: Column | str, returning: Column | str | None = None, default: Column | None = None) -> Column:
    """The scalar at a path. returning NUMBER (or another numeric type): as a number; default: where there is none."""
    part = _part(doc, path)
    value = F.when(~_is_tree(part), _plain(part))
    kind = "" if returning is None else (_literal(returning) if isinstance(returning, Column) else returning).upper()
    if kind.startswith(("NUMBER", "INT", "FLOAT", "DEC")):
        value = value.try_cast("double")
    return value if default is None else F.coalesce(value, default)


@named("JSON_QUERY")
def json_query(doc: Column, path: Column | str, wrapper: Column | str | None = None) -> Column:
    """The object or array at a path; with a wrapper, a scalar (or nothing) in an array."""
    part = _part(doc, path)
    wrapped = wrapper is not None and (_literal(wrapper) if isinstance(wrapper, Column) else wrapper).upper() == "WITH WRAPPER"
    return F.when(_is_tree(part), part).otherwise(F.when(F.try_parse_json(doc).isNotNull(), F.concat(F.lit("["), F.coalesce(part, F.lit("")), F.lit("]"))) if wrapped else F.lit(None))


@named("JSON_EXISTS")
def json_exists(doc: Column, path: Column | str) -> Column:
    return F.coalesce(_part(doc, path) != "null", F.lit(False))


def json_tree(df, text: str):
    """df's rows, one for each value in the JSON document: key, value, type, fullkey, depth; parents come first."""
    items = F.from_json(over_texts(_tree, F.col(text)), "array<struct<key:string,value:string,type:string,fullkey:string,depth:int>>")
    return df.withColumn("__item", F.explode(items)).select("*", "__item.*").drop("__item")
