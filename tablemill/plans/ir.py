"""A closed plan language for answers: what may be computed is a fixed set of node types, compiled to columns; nothing is evaluated as code.

A plan is nested dicts (JSON). Value nodes: cell, lookup (the nth row of an evidence table whose label is L, in column C), literal, scale, abs, arith, reduce, argmax. Table nodes: evidence, filter, project, join,
aggregate, window, top, set. `validate` refuses unknown nodes and literals that look like data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Significant digits that a literal may have, and years that pass whatever their digits.
MAX_DIGITS, YEARS = 3, (2000, 2035)

VALUE_NODES = {"cell", "lookup", "literal", "scale", "abs", "arith", "reduce", "argmax", "scalar"}
TABLE_NODES = {"evidence", "filter", "project", "join", "aggregate", "window", "top", "set"}
_ARITH: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}
_REDUCE = {"sum": lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), "min": F.array_min, "max": F.array_max, "avg": lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)}
_COMPARE: dict[str, Callable[[Column, object], Column]] = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "contains": lambda a, b: F.contains(a, F.lit(b)), "in": lambda a, b: a.isin(b)}
_AGGREGATE = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median}


def significant_digits(value: float) -> int:
    """Digits without sign, point, exponent and zeros at either end; 1 at least."""
    mantissa = f"{abs(value):.10g}".partition("e")[0]
    return len(mantissa.replace(".", "").strip("0")) or 1


def is_benign(value: float) -> bool:
    """Whether a literal can be a factor, an index or a year rather than a number read from a table."""
    return value == 0 or (float(value).is_integer() and YEARS[0] <= abs(value) <= YEARS[1]) or significant_digits(value) <= MAX_DIGITS


def validate(plan: dict) -> list[str]:
    """What is wrong with a plan; empty if nothing is."""
    errors = []
    kind = plan.get("node") if isinstance(plan, dict) else None
    if kind not in VALUE_NODES | TABLE_NODES:
        return [f"unknown node {kind!r}"]
    if kind == "literal" and not is_benign(plan["value"]):
        errors.append(f"literal {plan['value']!r} looks like data")
    if kind == "scale" and not is_benign(plan["by"]):
        errors.append(f"factor {plan['by']!r} looks like data")
    if kind == "lookup" and not (isinstance(plan.get("label"), str) and isinstance(plan.get("column"), str) and isinstance(plan.get("table"), int) and isinstance(plan.get("nth", 0), int) and plan.get("nth", 0) >= 0):
        errors.append("a lookup names a table, a label, a column and an occurrence from 0")
    if kind == "arith" and plan.get("op") not in _ARITH or kind in ("reduce",) and plan.get("op") not in _REDUCE:
        errors.append(f"unknown operation {plan.get('op')!r}")
    for child in plan.values():
        for c in child if isinstance(child, list) else [child]:
            if isinstance(c, dict) and "node" in c:
                errors += validate(c)
            elif isinstance(c, dict) and isinstance(c.get("value"), dict) and "node" in c["value"]:
                errors += validate(c["value"])
    return errors


def value(plan: dict, cells: Column, rows: Column | None = None) -> Column:
    """A value node over `cells`, an array of numbers (a question's evidence in order), and `rows`, its evidence tables: a column.

    rows: array<array<struct<label, cells map<string, double>>>>, a table's rows in order. A lookup without such a table, row or column is null.
    """
    kind = plan["node"]
    if kind == "cell":
        return F.get(cells, F.lit(plan["index"]))
    if kind == "lookup":
        if rows is None:
            raise ValueError("a lookup needs evidence tables")
        same = F.filter(F.get(rows, F.lit(plan["table"])), lambda r: F.trim(r["label"]) == F.lit(plan["label"].strip()))
        return F.try_element_at(F.get(same, F.lit(plan.get("nth", 0)))["cells"], F.lit(plan["column"]))
    if kind == "literal":
        return F.lit(float(plan["value"]))
    if kind == "scale":
        return value(plan["of"], cells, rows) * F.lit(float(plan["by"]))
    if kind == "abs":
        return F.abs(value(plan["of"], cells, rows))
    if kind == "arith":
        return fold_left(_ARITH[plan["op"]], (value(p, cells, rows) for p in plan["of"]))
    if kind == "reduce":
        return _REDUCE[plan["op"]](F.array(*(value(p, cells, rows) for p in plan["of"])))
    if kind == "argmax":
        pairs = F.array(*(F.struct(value(p["value"], cells, rows).alias("v"), F.lit(float(p["key"])).alias("k")) for p in plan["of"]))
        return (F.array_min(pairs) if plan.get("least") else F.array_max(pairs))["k"]
    raise ValueError(f"not a value node: {kind!r}")


def table(plan: dict, frames: dict[str, DataFrame]) -> DataFrame:
    """A table node over named frames: a DataFrame."""
    kind = plan["node"]
    if kind == "evidence":
        return frames[plan["name"]]
    of = table(plan["of"], frames) if kind not in ("join", "set") else None
    if kind == "filter":
        column = F.trim(F.col(plan["column"])) if plan.get("trim") else F.col(plan["column"])
        return of.where(_COMPARE[plan["op"]](column, plan["value"]))
    if kind == "project":
        return of.select(*plan["columns"])
    if kind == "aggregate":
        return of.groupBy(*plan.get("by", [])).agg(*(_AGGREGATE[f](c).alias(name) for name, f, c in plan["of_columns"]))
    if kind == "window":
        w = Window.partitionBy(*plan.get("by", [])).orderBy(*(F.desc(c) if d else F.col(c) for c, d in plan["order"]))
        return of.withColumn(plan["as"], F.row_number().over(w))
    if kind == "top":
        return of.orderBy(*(F.desc(c) if d else F.col(c) for c, d in plan["order"])).limit(plan["n"])
    a, b = (table(p, frames) for p in plan["of"])
    if kind == "join":
        return a.join(b, plan["on"], plan.get("how", "inner"))
    return {"union": a.unionByName(b), "intersect": a.intersect(b), "except": a.subtract(b)}[plan["op"]]


def scalar(plan: dict, frames: dict[str, DataFrame], column: str, nth: int = 0, order: list[str] | None = None) -> float | None:
    """One finite number: the nth value of a column, by `order`; null for none, NaN or an infinity."""
    rows = table(plan, frames).orderBy(*(order or [column])).select(F.col(column).try_cast("double")).limit(nth + 1).collect()
    out = rows[nth][0] if len(rows) > nth else None
    return out if out is not None and out == out and abs(out) != float("inf") else None


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def to_sql(plan: dict, cells: str = "cells", rows: str = "rows") -> str:
    """A value node as Spark SQL text, for people to read and rerun."""
    kind = plan["node"]
    if kind == "cell":
        return f"get({cells}, {int(plan['index'])})"
    if kind == "lookup":
        return f"try_element_at(get(filter(get({rows}, {int(plan['table'])}), r -> trim(r.label) = {_quoted(plan['label'].strip())}), {int(plan.get('nth', 0))}).cells, {_quoted(plan['column'])})"
    if kind == "literal":
        return f"{float(plan['value'])!r}D"
    if kind == "scale":
        return f"({to_sql(plan['of'], cells, rows)} * {float(plan['by'])!r}D)"
    if kind == "abs":
        return f"abs({to_sql(plan['of'], cells, rows)})"
    if kind == "arith":
        return fold_left(lambda a, b: f"try_divide({a}, {b})" if plan["op"] == "/" else f"({a} {plan['op']} {b})", (to_sql(p, cells, rows) for p in plan["of"]))
    if kind == "reduce":
        xs = f"array({', '.join(to_sql(p, cells, rows) for p in plan['of'])})"
        total = f"aggregate({xs}, 0D, (a, x) -> a + x)"
        return {"sum": total, "avg": f"({total} / size({xs}))", "min": f"array_min({xs})", "max": f"array_max({xs})"}[plan["op"]]
    pairs = ", ".join(f"struct({to_sql(p['value'], cells, rows)}, {float(p['key'])!r}D)" for p in plan["of"])
    return f"{'array_min' if plan.get('least') else 'array_max'}(array({pairs})).col2"


def from_cell(table: int, label: str, column: str, nth: int, multiplier: float = 1.0, undirected: bool = False) -> dict:
    """The plan that reads one located cell by its label: the occurrence tells rows with the same label apart."""
    out: dict = {"node": "lookup", "table": table, "label": label, "column": column, "nth": nth}
    out = {"node": "abs", "of": out} if undirected else out
    return out if abs(multiplier - 1.0) <= 1e-12 else {"node": "scale", "of": out, "by": multiplier}


def from_solution(kind: str, n: int, years: list[int] | None = None, percent: bool = False, undirected: bool = False) -> dict:
    """The plan of a solver's answer over its n facts in order."""
    cell = lambda i: {"node": "cell", "index": i}
    if kind in ("SUM", "AVG", "MIN", "MAX"):
        out: dict = {"node": "reduce", "op": kind.lower(), "of": [cell(i) for i in range(n)]}
    elif kind == "ARGMAX_YEAR":
        out = {"node": "argmax", "of": [{"value": cell(i), "key": y} for i, y in enumerate(years or [])]}
    elif kind == "GROWTH":
        out = {"node": "arith", "op": "/", "of": [{"node": "arith", "op": "-", "of": [cell(1), cell(0)]}, {"node": "abs", "of": cell(0)}]}
    elif kind == "DIFF":
        out = {"node": "arith", "op": "-", "of": [cell(0), cell(1)]}
        out = {"node": "abs", "of": out} if undirected else out
    else:
        out = {"node": "arith", "op": "/", "of": [cell(0), {"node": "abs", "of": cell(1)}]}
    return {"node": "scale", "of": out, "by": 100.0} if percent else out
