"""The few file operations that the log needs, on a local disk or on any file system that Hadoop knows."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store(Protocol):
    """Paths are relative to the store's root; ``url`` makes one that Spark reads."""

    def url(self, path: str) -> str: ...
    def put_if_absent(self, path: str, data: bytes) -> bool: ...
    def read(self, path: str) -> bytes: ...
    def names(self, path: str) -> list[str]: ...
    def sizes(self, path: str) -> dict[str, int]: ...
    def size(self, path: str) -> int: ...
    def exists(self, path: str) -> bool: ...
    def move(self, source: str, target: str) -> None: ...
    def copy(self, source: str, target: str) -> None: ...
    def delete(self, path: str) -> None: ...


class LocalStore:
    """A folder. A file appears whole or not at all: it is written under another name and then linked."""

    def __init__(self, root: str):
        self.root = Path(root.removeprefix("file://"))

    def url(self, path: str) -> str:
        return f"file://{self.root.absolute() / path}"

    def put_if_absent(self, path: str, data: bytes) -> bool:
        target = self.root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        draft = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        with draft.open("wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            draft.unlink()
        return True

    def read(self, path: str) -> bytes:
        return (self.root / path).read_bytes()

    def names(self, path: str) -> list[str]:
        try:
            return sorted(os.listdir(self.root / path))
        except FileNotFoundError:
            return []

    def sizes(self, path: str) -> dict[str, int]:
        """The files of a folder with their sizes, by one listing."""
        try:
            with os.scandir(self.root / path) as found:
                return {x.name: x.stat().st_size for x in found if x.is_file()}
        except FileNotFoundError:
            return {}

    def size(self, path: str) -> int:
        return (self.root / path).stat().st_size

    def exists(self, path: str) -> bool:
        return (self.root / path).exists()

    def move(self, source: str, target: str) -> None:
        (self.root / target).parent.mkdir(parents=True, exist_ok=True)
        os.replace(self.root / source, self.root / target)

    def copy(self, source: str, target: str) -> None:
        """The target appears whole, in place of what was there."""
        where = self.root / target
        where.parent.mkdir(parents=True, exist_ok=True)
        draft = where.with_name(f".{where.name}.{uuid.uuid4().hex}")
        shutil.copyfile(self.root / source, draft)
        os.replace(draft, where)

    def delete(self, path: str) -> None:
        where = self.root / path
        if where.is_dir():
            shutil.rmtree(where, ignore_errors=True)
        else:
            where.unlink(missing_ok=True)


class HadoopStore:
    """A folder of a Hadoop file system whose rename without overwrite is atomic, as it is on HDFS.

    A file appears whole or not at all: it is written under another name and then renamed, which fails if the name is
    taken. A writer that dies in between leaves a draft that nobody reads.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        gateway, option = spark.sparkContext._gateway, self.jvm.org.apache.hadoop.fs.Options.Rename
        self.keep = gateway.new_array(option, 1)
        self.keep[0] = option.NONE

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.url(path))

    def url(self, path: str) -> str:
        return f"{self.root}/{path}".rstrip("/")

    def put_if_absent(self, path: str, data: bytes) -> bool:
        where = self._path(path)
        if self.fs.exists(where):
            return False
        folder, _, name = path.rpartition("/")
        draft = self._path(f"{folder}/.{name}.{uuid.uuid4().hex}")
        try:
            self._write(draft, data)
            return self._claim(draft, where)
        finally:
            self.fs.delete(draft, False)

    def _write(self, where, data: bytes) -> None:
        out = self.fs.create(where, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def _claim(self, draft, where) -> bool:
        """Renames the draft unless the name is taken."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(draft, where, self.keep)
        except Py4JJavaError:
            if self.fs.exists(where):
                return False
            raise
        return True

    def read(self, path: str) -> bytes:
        source = self.fs.open(self._path(path))
        try:
            return bytes(source.readAllBytes())
        finally:
            source.close()

    def names(self, path: str) -> list[str]:
        where = self._path(path)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def sizes(self, path: str) -> dict[str, int]:
        """The files of a folder with their sizes, by one listing."""
        where = self._path(path)
        return {x.getPath().getName(): x.getLen() for x in self.fs.listStatus(where) if x.isFile()} if self.fs.exists(where) else {}

    def size(self, path: str) -> int:
        return self.fs.getFileStatus(self._path(path)).getLen()

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self._path(target).getParent())
        if not self.fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def copy(self, source: str, target: str) -> None:
        """The target appears whole, in place of what was there."""
        folder, _, name = target.rpartition("/")
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(source), self.fs, self._path(draft), False, self.conf):
            raise OSError(f"cannot copy {source} to {target}")
        self.fs.delete(self._path(target), False)
        self.move(draft, target)

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


def open_store(spark: SparkSession, root: str) -> Store:
    return LocalStore(root) if "://" not in root or root.startswith("file://") else HadoopStore(spark, root)


def _is_io(error: Exception) -> bool:
    """Whether a store's error may pass: an OSError, or Java's counterpart, other than for a missing file."""
    if isinstance(error, Py4JJavaError):
        name = error.java_exception.getClass().getName()
        return "IOException" in name or "Timeout" in name or "java.net." in name
    return isinstance(error, OSError) and not isinstance(error, FileNotFoundError)


def retried(action: Callable, tries: int = 3, wait: float = 0.2):
    """``action()``, again after an error of the store, waiting a little longer each time."""
    for attempt in range(1, tries + 1):
        try:
            return action()
        except (OSError, Py4JJavaError) as e:
            if attempt == tries or not _is_io(e):
                raise
            time.sleep(wait * attempt)
