"""Where a table's objects are, relative to the root of the tables."""

from __future__ import annotations

import re
import uuid

from tarn.errors import FileValidation

_DATA = re.compile(r"tables/([A-Za-z0-9_]+)/data/part-(\d+)-([0-9a-f-]+)\.parquet")
_COMMIT = re.compile(r"(\d{20})\.json")
_CHECKPOINT = re.compile(r"checkpoint_(\d+)\.json")


def table_dir(table: str) -> str:
    return f"tables/{table}"


def result_dir(name: str) -> str:
    return f"results/{name}/result.parquet"


def data_file(number: int, unique: str | None = None) -> str:
    """A data file's path within its table."""
    return f"data/part-{number:05d}-{unique or uuid.uuid4()}.parquet"


def commit_file(version: int) -> str:
    return f"{version:020d}.json"


def checkpoint_file(version: int) -> str:
    return f"checkpoint_{version}.json"


def commit_version(name: str) -> int | None:
    """The version that a file of the log commits, or None if it is no commit."""
    found = _COMMIT.fullmatch(name)
    return int(found[1]) if found else None


def checkpoint_version(name: str) -> int | None:
    found = _CHECKPOINT.fullmatch(name)
    return int(found[1]) if found else None


def parse_data_file(path: str) -> tuple[str, int, str]:
    """(table, number, unique part) of a data file's path from the root."""
    found = _DATA.fullmatch(path)
    if not found:
        raise FileValidation(f"{path!r} is not a data file")
    return found[1], int(found[2]), found[3]


def check_relative(path: str) -> None:
    """Any path within the table's folder will do."""
    if not path or path.startswith("/") or "://" in path or ".." in path.split("/"):
        raise FileValidation(f"{path!r} is not a path within the table")
