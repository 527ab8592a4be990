"""Rewrites constructs that Spark SQL lacks, token by token: q-quoted texts, MINUS, LIMIT offset, count, FETCH FIRST, ROWNUM,
SAMPLE, comparisons with ANY, SOME and ALL, outer joins marked (+), @variables and DUAL. Everything else is passed on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PAIRS = {"[": "]", "(": ")", "{": "}", "<": ">"}
_LEX = re.compile(r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<q>[nN]?[qQ]'(.))|(?P<text>[nN]?'(?:[^']|'')*')|(?P<blob>[xX]'[0-9A-Fa-f]*')|(?P<name>[A-Za-z_][\w$#]*|"[^"]*"|`[^`]*`)|(?P<number>\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|\.\d+)|(?P<variable>@\w+)|(?P<outer>\(\s*\+\s*\))|(?P<op><=>|<>|!=|<=|>=|\|\||::|->>|->|:=|[-+*/%=<>&|~^(),.;:?\[\]{}])""", re.DOTALL)
COMPARE = {"=", "<>", "!=", "<", "<=", ">", ">="}
#: Words that end a FROM or WHERE clause.
AFTER = {"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "EXCEPT", "MINUS", "INTERSECT", "WINDOW", ";", ")"}


def quoted(text: str) -> str:
    """A text as a literal of Spark, whose backslash escapes."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lex(sql: str) -> list[str]:
    """Tokens without spaces and comments; texts as Spark's literals, "names" in backquotes."""
    out, at = [], 0
    while at < len(sql):
        m = _LEX.match(sql, at)
        if not m:
            raise ValueError(f"not understood: {sql[at : at + 20]!r}")
        at = m.end()
        if m["q"]:
            end = sql.find(PAIRS.get(m[3], m[3]) + "'", at)
            if end < 0:
                raise ValueError("a quoted text doesn't end")
            out.append(quoted(sql[at:end]))
            at = end + 2
        elif m["text"]:
            out.append(quoted(m["text"].lstrip("nN")[1:-1].replace("''", "'")))
        elif m["name"] and m["name"][0] == '"':
            out.append(f"`{m['name'][1:-1]}`")
        elif not m["space"]:
            out.append("(+)" if m["outer"] else m[0])
    return out


def word(tokens: list[str], i: int) -> str:
    return tokens[i].upper() if 0 <= i < len(tokens) else ""


def closing(tokens: list[str], i: int) -> int:
    """The place of the bracket that closes the one at i."""
    depth = 0
    for k in range(i, len(tokens)):
        depth += (tokens[k] == "(") - (tokens[k] == ")")
        if not depth:
            return k
    raise ValueError("a bracket isn't closed")


def operand(tokens: list[str], end: int) -> int:
    """Where the operand that ends before end begins: a name, literal, call or bracket."""
    i = end - 1
    if tokens[i] == ")":
        depth = 0
        while True:
            depth += (tokens[i] == ")") - (tokens[i] == "(")
            if not depth:
                break
            i -= 1
        if re.match(r"\w", tokens[i - 1]) and word(tokens, i - 1) not in ("WHERE", "AND", "OR", "NOT", "SELECT", "ON", "IN", "HAVING"):
            i -= 1
    while i >= 2 and tokens[i - 1] == ".":
        i -= 2
    return i


def split(tokens: list[str], at: str) -> list[list[str]]:
    """The parts between top-level separators; the AND of a BETWEEN doesn't part."""
    out, depth, between = [[]], 0, False
    for x in tokens:
        depth += (x == "(") - (x == ")")
        between |= x.upper() == "BETWEEN" and not depth
        if x.upper() == at and not depth and not (between and at == "AND"):
            out.append([])
        else:
            between &= not (x.upper() == "AND" and not depth)
            out[-1].append(x)
    return out


def any_or_all(tokens: list[str]) -> list[str]:
    """x op ANY (...) by the least or largest value of a subquery, or by each item of a list."""
    i = 0
    while i < len(tokens):
        how = {"ANY": "ANY", "SOME": "ANY", "ALL": "ALL"}.get(word(tokens, i))
        if not how or word(tokens, i - 1) not in COMPARE or word(tokens, i + 1) != "(":
            i += 1
            continue
        op, begin, end = word(tokens, i - 1).replace("!=", "<>"), operand(tokens, i - 1), closing(tokens, i + 1)
        left, inner = " ".join(tokens[begin : i - 1]), tokens[i + 2 : end]
        if word(inner, 0) not in ("SELECT", "WITH", "VALUES"):
            joint = " OR " if how == "ANY" else " AND "
            new = "(" + joint.join(f"{left} {op} {' '.join(x)}" for x in split(inner, ",")) + ")"
        else:
            inner = outer_joins(any_or_all(inner))
            rows = f"({' '.join(inner)}) AS `__q` (`__v`)"
            value = lambda f: f"(SELECT {f}(`__v`) FROM {rows})"  # noqa: E731, B023
            if op == "=" and how == "ANY":
                new = f"({left} IN ({' '.join(inner)}))"
            elif op == "<>" and how == "ALL":
                new = f"({left} NOT IN ({' '.join(inner)}))"
            elif op in ("=", "<>"):
                new = f"({left} {op} {value('min')} {'AND' if how == 'ALL' else 'OR'} {left} {op} {value('max')})"
            else:
                one = f"{left} {op} {value('min' if (op[0] == '>') == (how == 'ANY') else 'max')}"
                unknown = one if how == "ALL" else f"NOT {one}"
                #: Nothing: ANY is false, ALL is true. A null among the values makes what they don't decide unknown.
                new = f"(CASE WHEN (SELECT count(*) FROM {rows}) = 0 THEN {'false' if how == 'ANY' else 'true'} WHEN (SELECT count(*) - count(`__v`) FROM {rows}) > 0 AND coalesce({unknown}, true) THEN NULL ELSE {one} END)"
        tokens = [*tokens[:begin], new, *tokens[end + 1 :]]
        i = begin
    return tokens


def clause(tokens: list[str], start: int) -> int:
    """The end of the clause that starts after a FROM or WHERE."""
    i = start
    while i < len(tokens) and tokens[i].upper() not in AFTER:
        i = closing(tokens, i) if tokens[i] == "(" else i
        i += 1
    return i


def outer_joins(tokens: list[str]) -> list[str]:
    """FROM a, b WHERE a.k = b.k(+): a LEFT JOIN b ON a.k = b.k."""
    while "(+)" in tokens:
        mark = tokens.index("(+)")
        where = max(i for i in range(mark) if tokens[i].upper() == "WHERE")
        start = max(i for i in range(where) if tokens[i].upper() == "FROM")
        tables, end = split(tokens[start + 1 : where], ","), clause(tokens, where + 1)
        on: dict[str, list[str]] = {}
        rest = []
        for c in split(tokens[where + 1 : end], "AND"):
            marked = {c[operand(c, i)].upper() for i, x in enumerate(c) if x == "(+)"}
            if len(marked) > 1:
                raise ValueError("a condition marks two tables with (+)")
            (on.setdefault(marked.pop(), []) if marked else rest).append(" ".join(x for x in c if x != "(+)"))
        name = lambda t: t[-1].upper()
        joined = " CROSS JOIN ".join(" ".join(t) for t in tables if name(t) not in on)
        joined += "".join(f" LEFT JOIN {' '.join(t)} ON {' AND '.join(on[name(t)])}" for t in tables if name(t) in on)
        tokens = [*tokens[: start + 1], joined, *(["WHERE", " AND ".join(rest)] if rest else []), *tokens[end:]]
    return tokens


def row_limits(tokens: list[str]) -> list[str]:
    """WHERE ROWNUM <= n as a limit of the rows that the other conditions keep."""
    for i in range(len(tokens) - 1, -1, -1):
        if tokens[i].upper() != "WHERE":
            continue
        end = clause(tokens, i + 1)
        rest, limit = [], None
        for c in split(tokens[i + 1 : end], "AND"):
            if len(c) == 3 and c[0].upper() == "ROWNUM" and c[1] in ("<", "<=", "=") and c[2].isdigit():
                limit = int(c[2]) - (c[1] == "<")
                if c[1] == "=" and limit != 1:
                    limit = 0
            else:
                rest.append(c)
        if limit is not None:
            if word(tokens, end) in ("GROUP", "HAVING", "ORDER"):
                raise ValueError("ROWNUM counts rows before they are grouped or ordered; put that into a subquery")
            kept = [x for c in rest for x in ("AND", *c)][1:]
            tokens = [*tokens[:i], *(["WHERE", *kept] if kept else []), "LIMIT", str(limit), *tokens[end:]]
    return tokens


def translate(sql: str, variables: dict | None = None) -> str:
    """The text in Spark SQL."""
    tokens, out, i = lex(sql), [], 0
    while i < len(tokens):
        now, after = word(tokens, i), word(tokens, i + 1)
        if now[0] == "@":
            held = {k.upper(): v for k, v in (variables or {}).items()}.get(now[1:])
            out.append("NULL" if held is None else quoted(held) if isinstance(held, str) else str(held).upper() if isinstance(held, bool) else str(held))
        elif now == "MINUS" and after in ("SELECT", "ALL", "(", "VALUES"):
            out.append("EXCEPT")
        elif now == "FROM" and after == "DUAL" and word(tokens, i + 2) != ".":
            i += 1
        elif now == "SAMPLE" and (after == "(" or after == "BLOCK"):
            i += 1 + (after == "BLOCK")
            out += ["TABLESAMPLE", "(", tokens[i + 1], "PERCENT", ")"]
            i += 2
        elif now == "LIMIT" and word(tokens, i + 2) == ",":
            out += ["LIMIT", tokens[i + 3], "OFFSET", tokens[i + 1]]
            i += 3
        elif now == "OFFSET" and word(tokens, i + 2) in ("ROW", "ROWS"):
            out += ["OFFSET", tokens[i + 1]]
            i += 2
        elif now == "FETCH" and after in ("FIRST", "NEXT") and word(tokens, i + 4) == "ONLY":
            place = len(out) - 2 if len(out) > 1 and out[-2] == "OFFSET" else len(out)
            out[place:place] = ["LIMIT", tokens[i + 2]]
            i += 4
        else:
            out.append(tokens[i])
        i += 1
    text = " ".join(outer_joins(any_or_all(row_limits(out))))
    return re.sub(r"\s*\.\s*(?=[A-Za-z_`*])", ".", text)


def run(spark: SparkSession, sql: str, variables: dict | None = None, **args) -> DataFrame:
    """The rows of a statement; args are its bind parameters."""
    return spark.sql(translate(sql, variables), args=args or None)
