"""A source tree as a table: a Python data source that prunes folders while it lists them.

    tree.read(spark, root)                   path, name, ext, bytes, modified
    tree.read(spark, root, content=True)     content as well

A folder with an excluded name is not listed, let alone what is below it, and a file with one is left out. The
driver lists folders from the top only until there are enough for the tasks to share; a partition is one of
share of those folders with all below them, or of the files of those that were opened up, so there are no more tasks than `folders`. Filters on path, name, ext and bytes are pushed into
the listing: prefixes of paths rule folders out, and files are opened only if content is asked
for and all pushed filters hold. Any file system that pyarrow opens by its URI will do.

Defined results: ext is in lower case with its dot, empty without one, and .dockerfile for a bare Dockerfile; folders that cannot be listed
count as empty; links are followed to `depth` folders; a file that goes between listing and reading is left out; a root
without files gives no rows. Content is read as a whole, one file at a time.
"""

from __future__ import annotations

import contextlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from siftlake import dims
from siftlake.sources.folders import removed

NAME = "source_tree"
SCHEMA = "path string, name string, ext string, bytes long, modified timestamp"
#: Rows and bytes of content that one Arrow batch holds at most, and folders that the driver lists for tasks to share.
ROWS, BATCH_BYTES, FOLDERS, DEPTH = 2048, 16 << 20, 256, 64


def extension(name: str) -> str:
    dot = name.rfind(".")
    return ".dockerfile" if name.lower() == "dockerfile" else name[dot:].lower() if dot > 0 else ""


class Folder(D.InputPartition):
    """A folder below the root, and whether what is below it belongs to the partition too."""

    def __init__(self, below: str, deep: bool):
        super().__init__((below, deep))
        self.below, self.deep = below, deep


class Share(D.InputPartition):
    """Folders that one task reads."""

    def __init__(self, folders: list[Folder]):
        super().__init__([folder.value for folder in folders])
        self.folders = folders


class SourceTree(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA + ", content binary" * (self.options.get("content", "false").lower() == "true")

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return TreeReader(self.options, "content" in schema.names)


class TreeReader(D.DataSourceReader):
    def __init__(self, options: dict, content: bool = False):
        self.root, self.content = options["path"].rstrip("/") or "/", content
        self.excluded = set(options["excluded"].split("/")) if "excluded" in options else set(dims.EXCLUDED_NAMES)
        self.folders, self.depth = int(options.get("folders", FOLDERS)), int(options.get("depth", DEPTH))
        self.tests: list[Filter] = []

    # Pushed filters

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for one in filters:
            test = pushed(one)
            if test is None:
                yield one
            else:
                self.tests.append(test)

    def may_hold(self, below: str) -> bool:
        """Whether a path in a folder can pass the filters."""
        start = f"{below}/" if below else ""
        return all(any(start.startswith(p) or p.startswith(start) for p in test.prefixes) for test in self.tests if test.prefixes is not None)

    # Listing

    def system(self) -> tuple:
        from pyarrow import fs

        given = urlparse(self.root)
        if given.scheme in ("", "file"):
            return fs.LocalFileSystem(), unquote(given.path) if given.scheme else self.root
        return fs.FileSystem.from_uri(self.root)

    def listed(self, system, top: str, below: str) -> tuple[list[str], list]:
        """Folders and files right in a folder, by name; files that pass the filters."""
        from pyarrow import fs

        try:
            entries = system.get_file_info(fs.FileSelector(f"{top}/{below}" if below else top))
        except OSError:
            return [], []
        folders, files = [], []
        for entry in sorted(entries, key=lambda e: e.base_name):
            if entry.base_name in self.excluded:
                continue
            path = f"{below}/{entry.base_name}" if below else entry.base_name
            if entry.type == fs.FileType.Directory:
                if path.count("/") < self.depth and self.may_hold(path):
                    folders.append(path)
            elif entry.type == fs.FileType.File:
                row = {"path": path, "name": entry.base_name, "ext": extension(entry.base_name), "bytes": entry.size, "modified": entry.mtime}
                if all(test.holds(row[test.column]) for test in self.tests):
                    files.append(row)
        return folders, files

    def partitions(self) -> list[Share]:
        found = self.opened()
        return [Share(found[at :: self.folders]) for at in range(min(self.folders, len(found)))]

    def opened(self) -> list[Folder]:
        """Folders that together hold all files, listed from the top until there are enough."""
        system, top = self.system()
        open_, done = deque([""]), []
        while open_ and len(open_) < self.folders and len(done) < self.folders:
            below = open_.popleft()
            folders, files = self.listed(system, top, below)
            open_ += folders
            if files:
                done.append(Folder(below, False))
        return [*done, *(Folder(below, True) for below in open_)] or [Folder("", False)]

    # Reading

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, top = self.system()
        kinds = [("path", pa.string()), ("name", pa.string()), ("ext", pa.string()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]
        schema = pa.schema(kinds + [("content", pa.binary())] * self.content)
        rows, held = [], 0
        for row in (row for folder in partition.folders for row in self.files(system, top, folder)):
            if self.content:
                try:
                    with system.open_input_stream(f"{top}/{row['path']}") as opened:
                        row["content"] = opened.read()
                except FileNotFoundError:
                    continue
                held += len(row["content"])
            rows.append(row)
            if len(rows) == ROWS or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def files(self, system, top: str, folder: Folder) -> Iterator[dict]:
        open_ = [folder.below]
        while open_:
            folders, files = self.listed(system, top, open_.pop())
            yield from files
            if folder.deep:
                open_ += reversed(folders)


class Filter:
    """A test of one column of the listing, and the prefixes of paths that can pass it, if it has any."""

    def __init__(self, column: str, holds: Callable, prefixes: list[str] | None = None):
        self.column, self.holds, self.prefixes = column, holds, prefixes


def pushed(given: D.Filter) -> Filter | None:
    """The test that a filter stands for; None for what the listing cannot answer."""
    negated = isinstance(given, D.Not)
    one = given.child if negated else given
    (column, *deeper) = getattr(one, "attribute", ("",))
    if deeper or column not in ("path", "name", "ext", "bytes"):
        return None
    value = getattr(one, "value", None)
    if isinstance(one, D.IsNotNull):
        holds, prefixes = lambda v: True, None
    elif isinstance(one, D.In):
        members = set(value)
        if None in members:
            return None
        holds, prefixes = lambda v: v in members, sorted(members) if column == "path" else None
    elif isinstance(one, D.EqualTo | D.EqualNullSafe):
        holds, prefixes = lambda v: v == value, [value] if column == "path" else None
    elif isinstance(one, D.StringStartsWith):
        holds, prefixes = lambda v: v.startswith(value), [value] if column == "path" else None
    elif isinstance(one, D.StringEndsWith):
        holds, prefixes = lambda v: v.endswith(value), None
    elif isinstance(one, D.StringContains):
        holds, prefixes = lambda v: value in v, None
    elif isinstance(one, D.GreaterThan | D.GreaterThanOrEqual | D.LessThan | D.LessThanOrEqual):
        compare = {D.GreaterThan: "__gt__", D.GreaterThanOrEqual: "__ge__", D.LessThan: "__lt__", D.LessThanOrEqual: "__le__"}[type(one)]
        holds, prefixes = lambda v: getattr(v, compare)(value), None
    else:
        return None
    if value is None and not isinstance(one, D.IsNotNull):
        return None
    return Filter(column, lambda v: not holds(v)) if negated else Filter(column, holds, prefixes)


def read(spark: SparkSession, root: str, content: bool = False, **options: str) -> DataFrame:
    """The files below a folder; see the module. Turns the pushing of filters into Python sources on for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format(NAME).options(content=str(content).lower(), **options).load(root)


def write(files: DataFrame, root: str) -> int:
    """Write files (path, content) below a folder, each by the task that holds it, and return how many. For trees that other tools are to read."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = TreeReader({"path": root}).system()
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                folder = f"{top}/{path}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], type=pa.int64())], names=["n"])

    found = files.select("path", files["content"].cast("binary").alias("content")).mapInArrow(put, "n long").agg({"n": "sum"}).first()[0]
    return found or 0


def remove(spark: SparkSession, root: str) -> None:
    """Delete a tree that `write` made, its folders dealt to the tasks; the driver alone would take a time in proportion to all files. Links would be followed."""
    folders = TreeReader({"path": root, "excluded": ""}).opened()

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TreeReader({"path": root, "excluded": ""})
        system, top = reader.system()
        for batch in batches:
            for below, deep in zip(batch.column("below").to_pylist(), batch.column("deep").to_pylist(), strict=True):
                with contextlib.suppress(FileNotFoundError):  # a task that runs again
                    if deep:
                        system.delete_dir(f"{top}/{below}" if below else top)
                    else:
                        for row in reader.listed(system, top, below)[1]:
                            system.delete_file(f"{top}/{row['path']}")
            yield batch

    rows = spark.createDataFrame([(folder.below, folder.deep) for folder in folders], "below string, deep boolean")
    rows.repartition(min(len(folders), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(gone, rows.schema).count()
    removed(spark, root)
