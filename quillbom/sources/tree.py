"""Source trees as a data source that lists no more folders than it needs.

A partition is a folder near the root with all below it, so trees of many repositories are listed by
many tasks; folders that no detector reads are never listed, and filters on path, extension and size
that Spark pushes down keep files from being opened, and folders from being listed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from quillbom.functions import rules

SCHEMA = "path string, ext string, length long, content binary"
#: Folders that are listed while planning, at most, to find enough partitions.
PLANNED_FOLDERS = 1000
# Packages that are read although they lie in a skipped folder, how deep, and what is skipped in them.
VENDORED = re.compile(r"(?i)crypto|bcrypt|jwt|jsonwebtoken|jose|forge|sodium|nacl|elliptic|argon2|scrypt|pbkdf2|hash|cipher")
VENDORED_DEPTH = 4
VENDORED_SKIPPED = frozenset(("node_modules", ".git", "test", "tests"))


def wanted_folder(folder: str, vendored: bool = True) -> bool:
    """Whether a folder, relative to the root, may hold files that a detector reads."""
    parts = folder.split("/") if folder else []
    if not any(p in rules.SKIPPED_DIRS for p in parts):
        return True
    if not vendored or parts[0] != "node_modules":
        return False
    package = parts[1:3] if len(parts) > 1 and parts[1].startswith("@") else parts[1:2]
    if len(package) < (2 if package and package[0].startswith("@") else 1):
        return True  # where packages are listed
    inner = parts[1 + len(package):]
    return bool(VENDORED.search("/".join(package))) and len(inner) <= VENDORED_DEPTH and not VENDORED_SKIPPED.intersection(inner)


@dataclass
class Wanted:
    """What the pushed filters leave: files by path, extension and length, and so folders by path."""

    extensions: set[str] | None = None
    most: int | None = None
    starts: list[str] = field(default_factory=list)
    paths: set[str] | None = None

    def push(self, f: Filter) -> bool:
        """Whether the filter is taken over in full."""
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if isinstance(f, (EqualTo, In)) and name in ("ext", "path"):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            held = "extensions" if name == "ext" else "paths"
            before = getattr(self, held)
            setattr(self, held, values if before is None else before & values)
        elif isinstance(f, (LessThan, LessThanOrEqual)) and name == "length":
            bound = f.value - isinstance(f, LessThan)
            self.most = bound if self.most is None else min(self.most, bound)
        elif isinstance(f, StringStartsWith) and name == "path":
            self.starts.append(f.value)
        else:
            return False
        return True

    def folder(self, folder: str) -> bool:
        inside = f"{folder}/" if folder else ""
        if self.paths is not None and not any(p.startswith(inside) for p in self.paths):
            return False
        return all(inside.startswith(s) or s.startswith(inside) for s in self.starts)

    def file(self, path: str, length: int) -> bool:
        if self.extensions is not None and extension(path) not in self.extensions or self.most is not None and length > self.most:
            return False
        return (self.paths is None or path in self.paths) and all(path.startswith(s) for s in self.starts)


def extension(path: str) -> str:
    m = re.search(r"\.([^./]*)\Z", path)
    return m[1].lower() if m else ""


def listed(store: fs.FileSystem, root: str, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
    """(folders, files with their lengths) right in a folder, relative to the root."""
    folders, files = [], []
    for info in store.get_file_info(fs.FileSelector(f"{root}/{folder}" if folder else root)):
        path = f"{folder}/{info.base_name}" if folder else info.base_name
        if info.type == fs.FileType.Directory:
            folders.append(path)
        elif info.type == fs.FileType.File:
            files.append((path, info.size))
    return sorted(folders), sorted(files)


def walk(list_folder: Callable[[str], tuple[list[str], list[tuple[str, int]]]], start: str, enter: Callable[[str], bool]) -> Iterator[tuple[str, int]]:
    """Files below a folder, with folders entered only where they may hold some."""
    waiting = [start]
    while waiting:
        folders, files = list_folder(waiting.pop())
        yield from files
        waiting += [f for f in reversed(folders) if enter(f)]


@dataclass
class Folder(InputPartition):
    path: str
    below: bool

    def __init__(self, path: str, below: bool):
        self.path, self.below = path, below


class TreeReader(DataSourceReader):
    def __init__(self, root: str, content: bool, vendored: bool, parts: int):
        self.root, self.content, self.vendored, self.parts = root, content, vendored, parts
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.wanted.push(f):
                yield f

    def enter(self, folder: str) -> bool:
        return wanted_folder(folder, self.vendored) and self.wanted.folder(folder)

    def partitions(self) -> list[InputPartition]:
        """Folders level by level until there are enough of them; those that were listed on the way hold their own files only."""
        store, root = fs.FileSystem.from_uri(self.root)
        own, level, planned = [], [""], 0
        while level and len(level) < self.parts and planned < PLANNED_FOLDERS:
            below = []
            for folder in level:
                own.append(Folder(folder, False))
                below += [f for f in listed(store, root, folder)[0] if self.enter(f)]
            planned += len(level)
            level = below
        return own + [Folder(f, True) for f in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        store, root = fs.FileSystem.from_uri(self.root)
        list_folder = lambda f: listed(store, root, f)
        files = walk(list_folder, partition.path, self.enter) if partition.below else list_folder(partition.path)[1]
        for path, length in files:
            if self.wanted.file(path, length):
                content = None
                if self.content:
                    with store.open_input_stream(f"{root}/{path}") as stream:
                        content = stream.read()
                yield path, extension(path), length, content


class TreeSource(DataSource):
    """Options: path, content (false: names and lengths only), vendored (false: no packages), partitions."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        o = self.options
        path = o["path"] if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", o["path"]) else f"file://{o['path']}"
        return TreeReader(path.rstrip("/"), o.get("content", "true") != "false", o.get("vendored", "true") != "false", int(o.get("partitions", "64")))


def source_tree(spark: SparkSession, root: str, content: bool = True, vendored: bool = True, partitions: int = 64) -> DataFrame:
    """(path relative to root, ext, length, content) of the files below root, without the folders that no detector reads.

    Works in any store that Arrow opens by its address; repository.files() reads those that only
    Spark does, and lists all. Empty files come as rows here.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    options = {"content": str(content).lower(), "vendored": str(vendored).lower(), "partitions": str(partitions)}
    return spark.read.format("source_tree").options(**options).load(root)
