"""Aggregate functions of structured queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tarn.errors import QueryError, SchemaError

FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Aggregate:
    """``function`` of a column, of an expression over columns, or of ``*`` (count only)."""

    function: str
    column: str = "*"
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{self.function.lower()}_{self.column}"

    def over(self, df: DataFrame) -> Column:
        """The aggregate of ``df``, under its name; nulls are skipped, sums and means want numbers."""
        function = FUNCTIONS.get(self.function.lower())
        if function is None:
            raise QueryError(f"unknown aggregate {self.function!r}; there are {', '.join(FUNCTIONS)}")
        if self.column == "*":
            if self.function.lower() != "count":
                raise QueryError(f"{self.function}(*) has no meaning")
            return F.count(F.lit(1)).alias(self.name)
        plain = [x for x in df.columns if x.lower() == self.column.lower()]
        argument = F.col(f"`{plain[0]}`") if plain else F.expr(self.column)
        try:
            kind = df.select(argument).schema[0].dataType
        except Exception as e:
            raise SchemaError(f"cannot aggregate {self.column!r}: {e}") from e
        if self.function.lower() in ("sum", "avg") and not isinstance(kind, NumericType):
            raise QueryError(f"{self.function}({self.column}) wants a number, not {kind.simpleString()}")
        return function(argument).alias(self.name)


def as_aggregate(x) -> Aggregate:
    """An Aggregate, a (function, column[, alias]) or a {"function", "column", "alias"}."""
    if isinstance(x, Aggregate):
        return x
    return Aggregate(**x) if isinstance(x, dict) else Aggregate(*x)
