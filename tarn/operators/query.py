"""Structured queries: filter, then group, then project, order and limit. Catalyst plans the rest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.errors import QueryError, SchemaError
from tarn.functions.aggregates import Aggregate, as_aggregate
from tarn.operators.predicate import Comparison, as_comparisons, conjunction


@dataclass(frozen=True)
class Query:
    """What a structured query asks of one table; version None is the latest."""

    filters: list[Comparison] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregates: list[Aggregate] = field(default_factory=list)
    projection: list[str] | None = None
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    version: int | None = None

    @classmethod
    def of(cls, filters=None, group_by=(), aggregates=(), projection=None, order_by=(), limit=None, version=None) -> Query:
        """From loose arguments: texts for filters, tuples for aggregates, ``"column"`` or ``"column desc"`` to order by."""
        order = []
        for x in [order_by] if isinstance(order_by, str) else order_by:
            name, _, way = x.strip().rpartition(" ") if x.strip().lower().endswith((" asc", " desc")) else (x.strip(), "", "asc")
            order.append((name.strip(), way.lower() == "asc"))
        group = [group_by] if isinstance(group_by, str) else list(group_by)
        return cls(as_comparisons(filters), group, [as_aggregate(x) for x in aggregates], None if projection is None else list(projection), order, limit, version)

    @property
    def counts_only(self) -> bool:
        """Whether the number of rows answers it."""
        return bool(self.aggregates) and not self.filters and not self.group_by and all(x.function.lower() == "count" and x.column == "*" for x in self.aggregates)


def _columns(df: DataFrame, names: list[str]) -> list[str]:
    """The names as ``df`` spells them."""
    out = []
    for name in names:
        found = [x for x in df.columns if x == name] or [x for x in df.columns if x.lower() == name.lower()]
        if not found:
            raise SchemaError(f"no column {name!r}; there are {', '.join(df.columns)}")
        out.append(found[0])
    return out


def run(df: DataFrame, query: Query) -> DataFrame:
    """``query`` over ``df``, lazily. A filter may use columns that are not projected; a projection names output columns."""
    condition = conjunction(query.filters, df.schema)
    if condition is not None:
        df = df.where(condition)
    if query.aggregates:
        values = [x.over(df) for x in query.aggregates]
        keys = [F.col(f"`{x}`") for x in _columns(df, query.group_by)]
        df = df.groupBy(*keys).agg(*values) if keys else df.agg(*values)
    elif query.group_by:
        raise QueryError("a group by needs an aggregate")
    return finish(df, query)


def finish(df: DataFrame, query: Query) -> DataFrame:
    """Orders, projects and limits a result."""
    if query.order_by:
        names = _columns(df, [x for x, _ in query.order_by])
        df = df.orderBy(*[F.col(f"`{x}`").asc() if up else F.col(f"`{x}`").desc() for x, (_, up) in zip(names, query.order_by, strict=True)])
    if query.projection is not None:
        if not query.projection:
            raise QueryError("a projection needs a column")
        df = df.select(*[F.col(f"`{x}`") for x in _columns(df, query.projection)])
    if query.limit is not None:
        if query.limit < 0:
            raise QueryError("a limit cannot be negative")
        df = df.limit(query.limit)
    return df


def shuffled(df: DataFrame, partitions: int, columns: list[str] | None = None) -> DataFrame:
    """``df`` in a number of partitions: rows with equal ``columns`` together, or dealt round if there are none."""
    if not partitions or partitions < 1:
        raise QueryError("a shuffle needs a number of partitions")
    return df.repartition(partitions, *[F.col(f"`{x}`") for x in _columns(df, columns or [])])
