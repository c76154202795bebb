"""Folders of projects as a Spark data source: ``spark.read.format("latex_projects").load(root)``.

The driver lists the projects only; tasks walk the folders of their projects and stream files one at a time, so neither a large project nor many of them
stand in one place. Whatever is wrong with one file is a row of its own with an ``error``.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id string, path string, sha256 string, content binary, error string"
ARROW = pa.schema([("doc_id", pa.string()), ("path", pa.string()), ("sha256", pa.string()), ("content", pa.binary()), ("error", pa.string())])
#: Projects of a task, and bytes of a batch, unless options say otherwise.
PER_TASK, BATCH_BYTES = 100, 8_000_000


def order(path: str) -> tuple[str, str]:
    """The stable order of paths: composed and case-folded, then as they are."""
    return unicodedata.normalize("NFC", path).casefold(), path


@dataclass
class Projects(InputPartition):
    names: list[str]


class ProjectReader(DataSourceReader):
    """Options: ``path`` (the root), ``exclude`` (folders inside a project, comma-separated, that aren't entered), ``projectsPerTask``, ``maxFileBytes`` (none by default: larger files are errors)."""

    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}  # Spark doesn't tell their case
        if not options.get("path"):
            raise ValueError("the source needs a root: .load(root)")
        self.root = options["path"]
        self.exclude = {p.strip().strip("/") for p in options.get("exclude", "").split(",") if p.strip()}
        self.per_task = int(options.get("projectspertask", PER_TASK))
        self.limit = int(options["maxfilebytes"]) if "maxfilebytes" in options else None

    def _store(self) -> tuple[fs.FileSystem, str]:
        at = re.sub(r"^s3[an]://", "s3://", self.root)
        return fs.FileSystem.from_uri(at) if "://" in at else fs.FileSystem.from_uri("file://" + os.path.abspath(at.removeprefix("file:")))

    def partitions(self) -> Sequence[Projects]:
        store, base = self._store()
        names = sorted((i.base_name for i in store.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory), key=order)
        return [Projects(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)] or [Projects([])]

    @staticmethod
    def _listed(store: fs.FileSystem, at: str) -> list[tuple[str, bool, int]]:
        """Names in a folder, whether they are folders, and sizes. Arrow leaves out links that lead nowhere, so local folders are listed without it."""
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(at) as entries:
                return [(e.name, e.is_dir(), e.stat(follow_symlinks=False).st_size) for e in entries]
        return [(i.base_name, i.type == fs.FileType.Directory, i.size or 0) for i in store.get_file_info(fs.FileSelector(at))]

    def _files(self, store: fs.FileSystem, top: str) -> Iterator[tuple[str, int | None, str | None]]:
        """Path inside the project, size and what is wrong with it, in order; folders that can't be listed are errors as well."""
        found, waiting, local = [], [""], isinstance(store, fs.LocalFileSystem)
        real = os.path.realpath(top) if local else top
        while waiting:
            inside = waiting.pop()
            try:
                infos = self._listed(store, f"{top}/{inside}".rstrip("/"))
            except OSError as e:
                found.append((inside or ".", None, f"cannot be listed: {type(e).__name__}"))
                continue
            for name, folder, size in infos:
                path = f"{inside}/{name}".lstrip("/")
                if local and os.path.islink(f"{top}/{path}"):
                    target = os.path.realpath(f"{top}/{path}")
                    if not os.path.exists(target):
                        found.append((path, None, "a link leads nowhere"))
                        continue
                    if target != real and not target.startswith(real + os.sep):
                        found.append((path, None, "a link leads out of the project"))
                        continue
                    if os.path.isdir(target):  # its files are met where they are
                        continue
                if path in self.exclude:
                    continue
                if folder:
                    waiting.append(path)
                else:
                    found.append((path, size, None))
        yield from sorted(found, key=lambda f: order(f[0]))

    def read(self, partition: Projects) -> Iterator[pa.RecordBatch]:
        store, base = self._store()
        rows, held = [], 0
        for name in partition.names:
            for path, size, error in self._files(store, f"{base}/{name}"):
                content = None
                if error is None and self.limit is not None and size > self.limit:
                    error = f"larger than {self.limit} bytes"
                if error is None:
                    try:
                        with store.open_input_stream(f"{base}/{name}/{path}") as stream:
                            content = stream.read()
                    except OSError as e:
                        error = f"cannot be read: {type(e).__name__}"
                rows.append((name, path, hashlib.sha256(content).hexdigest() if content is not None else None, content, error))
                held += len(content or b"") + 200
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([] for _ in ARROW)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class ProjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "latex_projects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProjectReader:
        return ProjectReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``latex_projects`` known to a session."""
    spark.dataSource.register(ProjectSource)
