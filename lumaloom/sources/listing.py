"""Folder listings as DataFrames."""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import media as M

#: What a scan leaves out.
SKIP = r"(^|/)(\.index|\.[^/]*\.part|[^/]*\.tmp)(/|$)"
SKIPPED_NAME = r"(?i:\.index)|\..*\.part|.*\.tmp"


def discover(spark: SparkSession, root: str, extensions: list[str] | None = None, content: bool = False) -> DataFrame:
    """path (relative), size, mtime, and sha of the content if asked for: media files below a folder."""
    known = extensions or [*M.JPEG, *M.RAW, *M.VIDEO, *M.OTHER_IMAGE]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "file:" + root.rstrip("/") if root.startswith("/") else root.rstrip("/")
    plain = F.regexp_replace("path", r"^file:/+", "file:/")
    rel = F.when(plain.startswith(base + "/"), F.substr(plain, F.lit(len(base) + 2))).otherwise(plain)
    out = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *([F.sha2("content", 256).alias("sha")] if content else []))
    return out.filter(M.extension(F.col("path")).isin(known) & ~F.col("path").rlike(SKIP))


def analyse_folders(listing: DataFrame) -> DataFrame:
    """folder, files, bytes, extensions (map): recursive totals of every folder; direct counts go up the tree."""
    direct = listing.groupBy(M.parent_folder(F.col("path")).alias("f"), M.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    up = direct.select(F.explode(M.folder_prefixes(F.col("f"))).alias("folder"), "ext", "n", "b").groupBy("folder", "ext").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    return up.groupBy("folder").agg(F.sum("n").cast("long").alias("files"), F.sum("b").cast("long").alias("bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("extensions"))


#: How many names of files a folder's report shows.
EXAMPLES = 5


def folder_report(listing: DataFrame) -> DataFrame:
    """One row a folder, the root and folders that only have subfolders included, from listing(path, size).

    direct_* counts what lies in the folder itself, the rest what lies below as well:
    files, bytes, recognised files and bytes (of known media), maps of counts by
    extension (``(none)`` without one) and by category, and the first five names of
    media files, without case.  A listing of files knows no empty folders.

    Files are counted by folder and extension before anything goes up the tree, and
    examples are a ranking that each task cuts to five names a folder before the shuffle.
    """
    # each part of a path is taken from it once
    parts = F.struct(M.parent_folder(F.col("path")).alias("own"), M.extension(F.col("path")).alias("ext"), M.base_name(F.col("path")).alias("name"), "size")
    listing, ext = listing.select(F.inline(F.array(parts))), F.col("ext")
    direct = listing.groupBy("own", F.when(ext == "", "(none)").otherwise(ext).alias("ext")).agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("b"))
    at, here = F.explode(M.folder_prefixes(F.col("own"))).alias("folder"), F.col("own") == F.col("folder")
    up = direct.select(at, "own", "ext", "n", "b").groupBy("folder", "ext").agg(*[F.sum(F.when(c, F.col(x))).cast("long").alias(y) for c, x, y in ((here, "n", "dn"), (here, "b", "db"), (F.lit(True), "n", "n"), (F.lit(True), "b", "b"))])
    up = up.withColumn("cat", M.media_category(F.col("ext")))
    counts = lambda key, n: F.when(F.col(n).isNotNull(), F.struct(F.col(key).alias("k"), F.col(n).alias("n")))
    by_key = lambda key, n: F.map_from_entries(F.array_sort(F.collect_list(counts(key, n))))
    known, total = F.col("cat") != "other", lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    extensions = up.groupBy("folder").agg(
        total("dn").alias("direct_files"), total("n").alias("files"), total("db").alias("direct_bytes"), total("b").alias("bytes"), total(F.when(known, F.col("n"))).alias("recognized_files"), total(F.when(known, F.col("b"))).alias("recognized_bytes"),
        by_key("ext", "dn").alias("direct_extensions"), by_key("ext", "db").alias("direct_extension_bytes"), by_key("ext", "n").alias("extensions"),
        *[total(F.when(F.col("cat") == c, F.col(n))).alias(f"{n}_{c}") for n in ("dn", "n") for c in M.CATEGORIES],
    )
    present = lambda n: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"{n}_{c}").alias("n")) for c in M.CATEGORIES]), lambda e: e["n"] > 0))
    first = F.row_number().over(Window.partitionBy("folder").orderBy("key", "name"))
    named = listing.filter(M.media_category(ext) != "other").select(F.col("own").alias("folder"), M.casefold(F.col("name")).alias("key"), "name").withColumn("__r", first).filter(F.col("__r") <= EXAMPLES)
    examples = named.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("key", "name")))["name"].alias("examples"))
    return extensions.join(examples, "folder", "left").select(
        "folder", "direct_files", "files", "direct_bytes", "bytes", "recognized_files", "recognized_bytes", "direct_extensions", "direct_extension_bytes", "extensions",
        present("dn").alias("direct_categories"), present("n").alias("categories"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
    )


class FolderTree(DataSource):
    """``spark.read.format("folder_tree")``: the files of a tree that all machines have mounted.

    Options: ``path``; ``extensions`` (comma-joined, default: known media);
    ``skip`` (a pattern for names of files and folders that a scan leaves out);
    ``parts`` (how many subtrees to aim at, default 64).  Rows: path (relative to
    the root), size, modified (microseconds) and issue.  A file or folder that
    can't be read is a row with its path and the error as issue, and the others go
    on; links are not followed; an unreadable root is one row with an empty path.

    The driver opens folders, the ones nearest to the root first, until there are
    ``parts`` of them; those that are still closed then are dealt to as many tasks,
    which read them whole, and another task reads the files of the open ones.  A folder with most of the
    files is opened like any other, so its subfolders are tasks of their own.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return "path string, size long, modified long, issue string"

    def reader(self, schema: StructType) -> DataSourceReader:
        known = self.options.get("extensions")
        return _TreeReader(
            self.options["path"].removeprefix("file://"),
            frozenset(known.lower().split(",") if known else [*M.JPEG, *M.RAW, *M.VIDEO, *M.OTHER_IMAGE]),
            self.options.get("skip", SKIPPED_NAME),
            int(self.options.get("parts", 64)),
        )


class _Subtree(InputPartition):
    def __init__(self, folders: list[str], deep: bool):
        self.folders, self.deep = folders, deep


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, known: frozenset[str], skip: str, parts: int):
        self.root, self.known, self.skip, self.parts = root, known, skip, parts

    def partitions(self) -> list[InputPartition]:
        opened, closed = [], deque([""])
        while closed and len(opened) + len(closed) < self.parts:
            folder = closed.popleft()
            opened.append(folder)
            closed.extend(p for p, is_folder, *_ in self._entries(folder) if is_folder)
        flat = [_Subtree(opened, False)] if opened else []
        rest = list(closed)
        return flat + [_Subtree(rest[i :: self.parts], True) for i in range(min(len(rest), self.parts))]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        waiting = list(partition.folders)
        while waiting:
            for path, is_folder, size, modified, issue in self._entries(waiting.pop()):
                if is_folder:
                    if partition.deep:
                        waiting.append(path)
                elif issue is not None or os.path.splitext(path)[1].lower() in self.known:
                    yield path, size, modified, issue

    def _entries(self, folder: str) -> Iterator[tuple]:
        """(path, is_folder, size, modified, issue) of what lies in a folder, or one issue if it can't be opened."""
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                for e in found:
                    path = f"{folder}/{e.name}" if folder else e.name
                    try:
                        if e.is_symlink() or re.fullmatch(self.skip, e.name):
                            continue
                        if e.is_dir(follow_symlinks=False):
                            yield path, True, None, None, None
                        elif e.is_file(follow_symlinks=False):
                            s = e.stat(follow_symlinks=False)
                            yield path, False, s.st_size, s.st_mtime_ns // 1000, None
                    except OSError as error:
                        yield path, False, None, None, error.strerror
        except OSError as error:
            yield folder, False, None, None, error.strerror


def scan_tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """``folder_tree`` of ``root``: path, size, modified, issue."""
    spark.dataSource.register(FolderTree)
    return spark.read.format("folder_tree").options(**{k: str(v) for k, v in options.items()}).load(root)


def unreadable(scan: DataFrame) -> list[str]:
    """Prefixes that a scan couldn't read: ``snapshots.diff`` keeps what was known below them.  One entry for each issue."""
    return [r["path"] for r in scan.filter("issue is not null").select("path").distinct().collect()]
