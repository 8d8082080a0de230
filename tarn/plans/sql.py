"""SQL over pinned snapshots, whose files are skipped by their bounds."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tarn.errors import TableNotFound
from tarn.operators.predicate import Comparison
from tarn.sources import files as sources
from tarn.sources.stats import may_hold

#: Spark's filters on a scan that bounds can answer, as comparisons.
_OPS = {"EqualTo": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}


def sql(lake, text: str, versions: dict[str, int] | None = None) -> DataFrame:
    """Runs ``text`` with a view for each of the lake's tables that it names, over the files of one version each.

    Versions are the latest unless given. All are looked up before anything runs, and the views are those of a
    session made for this query, with the settings of the lake's, so neither later commits nor other queries change
    what it reads. Files whose bounds exclude what the plan filters a table by are not opened.
    """
    versions = dict(versions or {})
    words = {x.lower() for x in re.findall(r"[A-Za-z0-9_]+", text)}
    named = [x for x in lake.list_tables() if x.lower() in words]
    if unknown := set(versions) - set(named):
        raise TableNotFound(f"the query names no table {', '.join(sorted(unknown))}")
    session = _session(lake.spark)
    tables = {x: lake.table(x) for x in named}
    held = {x: table.snapshot(versions.get(x)) for x, table in tables.items()}
    for name, now in held.items():
        _view(session, name, tables[name], now.schema, now.files)
    df = session.sql(text)
    zone = session.conf.get("spark.sql.session.timeZone")
    scans = _scans(df, {x: lake.store.url(f"{table.folder}/") for x, table in tables.items()}) if held else None
    fewer = False
    for name, filters in (scans or {}).items():
        now = held[name]
        # A file is read if any scan of its table may need it.
        needed = [x for x in now.files if any(all(may_hold(x, c, now.schema, zone) for c in scan) for scan in filters)]
        if len(needed) < len(now.files):
            _view(session, name, tables[name], now.schema, needed)
            fewer = True
    return session.sql(text) if fewer else df


def _session(spark: SparkSession) -> SparkSession:
    """A new session with the settings of ``spark``."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def _view(session: SparkSession, name: str, table, schema, files) -> None:
    sources.scan(session, [table._url(x.path) for x in files], schema).createOrReplaceTempView(name)


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _scans(df: DataFrame, folders: dict[str, str]) -> dict[str, list[list[Comparison]]] | None:
    """The comparisons that each scan of a table is filtered by; None if the plan has scans that are not in sight."""
    run = df._jdf.queryExecution()
    strategy = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.datasources, "DataSourceStrategy$"), "MODULE$")
    if not run.optimizedPlan().subqueriesAll().isEmpty():
        return None
    found: dict[str, list[list[Comparison]]] = {}
    for leaf in _items(run.sparkPlan().collectLeaves()):
        if leaf.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        path = leaf.relation().location().rootPaths().head().toString()
        for name, folder in folders.items():
            if re.sub("^file:/+", "/", path).startswith(re.sub("^file:/+", "/", folder)):
                translated = (strategy.translateFilter(x, True) for x in _items(leaf.dataFilters()))
                found.setdefault(name, []).append([c for x in translated if x.isDefined() for c in _comparisons(x.get())])
    return found


def _comparisons(x) -> list[Comparison]:
    """What a filter of Spark's asks of bounds: a comparison, for a list of values the range that holds them, or nothing."""
    kind = x.getClass().getSimpleName()
    if kind in _OPS:
        value = _literal(x.value())
        return [] if value is None else [Comparison(x.attribute(), _OPS[kind], value)]
    if kind == "In":
        values = [_literal(v) for v in x.values() if v is not None]
        if not values or None in values or len({type(v) for v in values}) > 1:
            return []
        order = sorted(values, key=lambda v: v.encode() if isinstance(v, str) else v)
        return [Comparison(x.attribute(), ">=", order[0]), Comparison(x.attribute(), "<=", order[-1])]
    return []


def _literal(value):
    """A value that bounds compare with; dates and times as ISO text; None for others."""
    if isinstance(value, str | bool | int | float):
        return value
    kind = value.getClass().getSimpleName() if hasattr(value, "getClass") else ""
    if kind == "Timestamp":
        value = value.toInstant()
    elif kind not in ("LocalDate", "LocalDateTime", "Instant", "Date"):
        return None
    return value.toString()
