"""Trees of names as edge tables: from lists of paths, and from directories by a Python data source.

``path, parent, name, is_dir, files``: the root has the path ``''`` and no parent; ``files`` counts the files beneath.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Entries a scanned directory may have in all.
MAX_NODES = 300_000
SKIPPED = {"node_modules"}


def nodes_of_paths(paths: DataFrame, col: str = "path") -> DataFrame:
    """Nodes of a list of paths, one per row.

    ``./`` is stripped, paths that go up are dropped, absolute paths share the tree (their ``absolute`` is true), a trailing
    ``/`` marks a directory, as does having anything beneath.  Blank and null rows are skipped.
    """
    raw = F.regexp_replace(F.col(col), "\\r\\z", "")
    p = paths.select(raw.alias("raw")).where(F.col("raw").rlike("\\S"))
    parts = F.filter(F.split("raw", "/"), lambda x: ~x.isin("", "."))
    p = p.withColumn("parts", parts).where((F.size("parts") > 0) & ~F.array_contains("parts", ".."))
    p = p.withColumn("dir", F.col("raw").endswith("/")).withColumn("abs", F.col("raw").startswith("/"))
    steps = p.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("parts"))))
    at = steps.select(
        F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/").alias("path"),
        F.array_join(F.slice("parts", F.lit(1), F.col("n") - 1), "/").alias("parent"),
        F.element_at("parts", F.col("n")).alias("name"),
        ((F.col("n") < F.size("parts")) | F.col("dir")).alias("is_dir"), F.col("abs"),
    )
    nodes = at.groupBy("path").agg(F.first("parent").alias("parent"), F.first("name").alias("name"), F.max("is_dir").alias("is_dir"), F.max("abs").alias("absolute"))
    leaves = nodes.where("not is_dir").select(F.split("path", "/").alias("parts"))
    up = leaves.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("parts")))).select(F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/").alias("path"))
    counts = up.groupBy("path").agg(F.count(F.lit(1)).alias("files"))  # of a file itself: 1
    return nodes.join(counts, "path", "left").withColumn("files", F.coalesce("files", F.lit(0)))


class _Part(InputPartition):
    def __init__(self, root: str, entries: list[str]) -> None:
        self.root, self.entries = root, entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("path") or options["root"]
        self.hidden = str(options.get("hidden", "false")).lower() == "true"

    def _keep(self, name: str) -> bool:
        return self.hidden or not (name.startswith(".") or name in SKIPPED)

    def partitions(self) -> Sequence[InputPartition]:
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root}: not a directory")
        top = sorted(e for e in os.listdir(self.root) if self._keep(e))
        return [_Part(self.root, top[i::8]) for i in range(min(8, len(top)))] or [_Part(self.root, [])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for e in partition.entries:
            full = os.path.join(partition.root, e)
            if not os.path.isdir(full) or os.path.islink(full):
                yield (e,)
                continue
            yield (e + "/",)
            for base, dirs, files in os.walk(full):
                rel = os.path.relpath(base, partition.root)
                for d in list(dirs):
                    if not self._keep(d):
                        dirs.remove(d)
                        continue
                    yield (f"{rel}/{d}" + ("" if os.path.islink(os.path.join(base, d)) else "/"),)
                for f in files:
                    if self._keep(f):
                        yield (f"{rel}/{f}",)


class DirectorySource(DataSource):
    """``spark.read.format("semframe_tree").option("hidden", …).load(dir)``: paths below a directory, directories with a
    trailing slash; hidden names and package folders are skipped unless ``hidden``; links are not followed."""

    @classmethod
    def name(cls) -> str:
        return "semframe_tree"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_directory(spark: SparkSession, root: str, hidden: bool = False, most: int = MAX_NODES) -> DataFrame:
    """The nodes below a directory; an error if there are more than ``most`` in all."""
    spark.dataSource.register(DirectorySource)
    nodes = nodes_of_paths(spark.read.format("semframe_tree").option("hidden", str(hidden).lower()).option("root", root).load())
    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} entries")
    return nodes
