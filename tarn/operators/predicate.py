"""Filters of structured queries: a column, a comparison and a literal."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.errors import FilterError, SchemaError
from tarn.types import NUMERIC, type_name

#: Both spellings of a comparison, and the one used here.
OPERATORS = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", ">": ">", "<": "<", ">=": ">=", "<=": "<="}
_FILTER = re.compile(r"\s*([^\s=!<>'\"]+)\s*(==|!=|<>|>=|<=|=|>|<)\s*(.+?)\s*", re.S)
_TEXT = re.compile(r"'((?:[^']|'')*)'|\"((?:[^\"]|\"\")*)\"", re.S)
_INT, _FLOAT = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?")


@dataclass(frozen=True)
class Comparison:
    column: str
    op: str
    value: object

    def on(self, schema: StructType) -> Column:
        """The condition as a column of ``schema``, checked against the column's type."""
        found = [f for f in schema if f.name == self.column] or [f for f in schema if f.name.lower() == self.column.lower()]
        if not found:
            raise SchemaError(f"no column {self.column!r}; there are {', '.join(schema.names)}")
        kind, value = type_name(found[0].dataType), self.value
        number = isinstance(value, int | float) and not isinstance(value, bool)
        if kind == "boolean":
            if not isinstance(value, bool) or self.op not in ("=", "!="):
                raise FilterError(f"boolean column {self.column!r} compares by = and != with true or false only")
        elif kind in NUMERIC:
            if not number:
                raise FilterError(f"column {self.column!r} is {kind} and does not compare with {value!r}")
        elif not isinstance(value, str):
            raise FilterError(f"column {self.column!r} is {kind} and does not compare with {value!r}")
        left, right = F.col(f"`{found[0].name}`"), F.lit(value)
        if kind in ("date", "timestamp", "timestamp_ntz"):
            right = right.cast(found[0].dataType)
        return {"=": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[self.op]


def parse(text: str) -> Comparison:
    """``column op literal``; the literal is an integer, a decimal, true, false or a quoted string (its quote doubled inside)."""
    found = _FILTER.fullmatch(text)
    if not found:
        raise FilterError(f"{text!r} is not 'column operator literal'")
    column, op, raw = found.groups()
    quoted = _TEXT.fullmatch(raw)
    if quoted:
        value: object = quoted[1].replace("''", "'") if quoted[1] is not None else quoted[2].replace('""', '"')
    elif _INT.fullmatch(raw):
        value = int(raw)
    elif _FLOAT.fullmatch(raw):
        value = float(raw)
    elif raw.lower() in ("true", "false"):
        value = raw.lower() == "true"
    else:
        raise FilterError(f"{raw!r} is neither a number, true, false nor a quoted string")
    return Comparison(column, OPERATORS[op], value)


def as_comparisons(filters) -> list[Comparison]:
    """One filter or several, each a text, a triple or a Comparison."""
    if filters is None:
        return []
    if isinstance(filters, str | Comparison) or (isinstance(filters, tuple) and len(filters) == 3 and isinstance(filters[1], str) and filters[1] in OPERATORS):
        filters = [filters]
    out = []
    for x in filters:
        if isinstance(x, str):
            out.append(parse(x))
        elif isinstance(x, Comparison):
            out.append(x)
        else:
            column, op, value = x
            if op not in OPERATORS:
                raise FilterError(f"unknown operator {op!r}")
            out.append(Comparison(column, OPERATORS[op], value))
    return out


def conjunction(filters: list[Comparison], schema: StructType) -> Column | None:
    """All filters at once; rows for which one is null go, as in SQL."""
    parts = [x.on(schema) for x in filters]
    return reduce(lambda a, b: a & b, parts) if parts else None
