"""Source files of repositories: spark.read.format("code_repo"), and the tables derived from it."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENDINGS = (".ts", ".tsx", ".js", ".jsx")
EXCLUDED = frozenset(["node_modules", "dist", "build", "out", ".next"])
MANIFESTS = ("package.json", "requirements.txt")
PARTS = 8


class _Part(InputPartition):
    """The part-th of parts of a repository's files."""

    def __init__(self, root: str, part: int, parts: int):
        self.root, self.part, self.parts = root, part, parts


class CodeRepository(DataSource):
    """Options: path, one repository or several separated by commas, plain or as URIs of a storage; kind, sources (default)
    or manifests; parts, tasks for each repository. Tasks list and read the files, the driver sees neither.

    Unlike the text source it reads files whose names start with an underscore. Directories that start with a dot or
    are in EXCLUDED aren't entered. A file that can't be read is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "code_repo"

    def schema(self) -> str:
        return "repo string, file string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _listed(files, root: str, folder: str) -> Iterator[str]:
    """Paths of source files below a folder, relative to the root, in order."""
    from pyarrow import fs

    found = sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name)
    for f in found:
        if f.type == fs.FileType.File and f.base_name.endswith(ENDINGS) and not f.base_name.startswith("."):
            yield f.path[len(root) :].lstrip("/")
    for f in found:
        if f.type == fs.FileType.Directory and f.base_name not in EXCLUDED and not f.base_name.startswith("."):
            yield from _listed(files, root, f.path)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [p if "://" in p else os.path.abspath(p) for p in options.get("path", "").split(",") if p]
        self.kind = options.get("kind", "sources")
        self.parts = int(options.get("parts", PARTS)) if self.kind == "sources" else 1

    def partitions(self) -> list[InputPartition]:
        return [_Part(root, k, self.parts) for root in self.roots for k in range(self.parts)] or [_Part("", 0, 1)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.root:
            return
        files, root = fs.FileSystem.from_uri(partition.root)
        root = root.rstrip("/")
        for file in _listed(files, root, root) if self.kind == "sources" else MANIFESTS:
            if zlib.crc32(file.encode("utf-8", "surrogatepass")) % partition.parts != partition.part:
                continue
            try:
                with files.open_input_stream(f"{root}/{file}") as f:
                    yield partition.root, file, f.read().decode("utf-8-sig", "replace")
            except OSError:
                continue


def _read(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    spark.dataSource.register(CodeRepository)
    return spark.read.format("code_repo").option("path", ",".join(paths)).option("kind", kind).load()


def source_files(spark: SparkSession, *paths: str) -> DataFrame:
    return _read(spark, list(paths), "sources")


def manifest_files(spark: SparkSession, *paths: str) -> DataFrame:
    return _read(spark, list(paths), "manifests")


def source_lines(files: DataFrame) -> DataFrame:
    """repo, file, line (from 1), text."""
    return files.select("repo", "file", F.posexplode(F.split("text", r"\r?\n", -1)).alias("n", "text")).select("repo", "file", (F.col("n") + 1).alias("line"), "text")
