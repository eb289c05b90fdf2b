"""Tables kept sorted in layers: an update adds a layer, and what it replaces is marked as gone.

A layer holds the rows that one update adds to each table, dealt by ranges of
the table's key and sorted by it, so a Parquet file covers a narrow range and a
search for a key or a range reads the row groups that match. Rows belong to a
file; a layer also names the files that its update replaces, and their rows in
earlier layers count no more. Counts are kept as signed differences and added
up by key when read.

An update is seen as a whole or not at all: its last step is an empty file in
`log` that names the layer. What an update left behind that broke off is
written over by the next one. compact() writes all that counts as one layer.
One update runs at a time.

A layer can also be put off (add_later): each of its tables is written when it
is first read, so a question costs the tables that it reads and no others.
Only the Layers that put it off can write them; to another one a table that was
not asked for yet is a missing folder, an error.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ravelin.plans.tables import CLEANUP, settings

LAYER, GONE = "layer", "gone"
#: Tables of a layer that are written at the same time.
AT_ONCE = 4
_TYPES = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "binary": BinaryType()}


def columns(text: str) -> StructType:
    """A schema from `name type, ...`, without a session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(","))])


class Layout(NamedTuple):
    """A table's columns and what it is sorted by. sums: columns that are added up by the key; else rows have a column `file`."""

    schema: StructType
    key: tuple[str, ...]
    sums: tuple[str, ...] = ()


class Layers:
    def __init__(self, spark: SparkSession, folder: str, layouts: dict[str, Layout]):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.layouts = layouts | {GONE: Layout(columns("file string"), ("file",))}
        self._later: dict[str, tuple[int, Callable[[], DataFrame]]] = {}

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def committed(self) -> list[int]:
        """The layers that count, the first one holding all before it."""
        files, log = self._path("log")
        names = sorted(s.getPath().getName() for s in files.listStatus(log)) if files.exists(log) else []
        base = max((i for i, n in enumerate(names) if n.endswith("-base")), default=0)
        return [int(n.split("-")[0]) for n in names[base:]]

    def _write(self, name: str, number: int, new: DataFrame | None, few: bool = False) -> None:
        layout = self.layouts[name]
        if new is None:
            new = self.spark.createDataFrame([], layout.schema)
        new = new.select(*(F.col(f.name).cast(f.dataType) for f in layout.schema))
        if layout.sums:
            new = new.groupBy(*layout.key).agg(*(F.sum(c).alias(c) for c in layout.sums))
            new = new.where(" OR ".join(f"{c} <> 0" for c in layout.sums)).select(*layout.schema.names)
        elif name == GONE:
            new = new.distinct()
        laid = (new.coalesce(1) if few else new.repartitionByRange(*layout.key)).sortWithinPartitions(*layout.key)
        laid.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}/{LAYER}={number}")

    def _commit(self, number: int, base: bool) -> None:
        files, log = self._path("log", f"{number:08d}{'-base' if base else ''}")
        files.create(log, False).close()
        if base:
            self._delete_before(number)

    def add(self, rows: dict[str, DataFrame], gone: DataFrame | None = None, base: bool = False, few: bool = False) -> None:
        """Adds a layer of rows, in place of those of the files in gone (column file). base: in place of everything.

        few: the rows are known to fit one task, which sorts each table; no ranges are looked for.
        """
        number = max(self.committed(), default=0) + 1
        with settings(self.spark, {CLEANUP: "true"}), ThreadPoolExecutor(AT_ONCE) as pool:  # tables do not wait for each other; their shuffle files go with them
            list(pool.map(lambda name: self._write(name, number, gone if name == GONE else rows.get(name), few), self.layouts))
        self._commit(number, base)
        if base:
            self._later.clear()

    def add_later(self, rows: dict[str, Callable[[], DataFrame]]) -> None:
        """Adds a layer in place of everything, whose tables are written when they are first read, from what their functions return then."""
        number = max(self.committed(), default=0) + 1
        self._write(GONE, number, None, True)
        self._commit(number, True)
        self._later = {name: (number, rows[name]) for name in self.layouts if name != GONE}

    def _lay(self, name: str) -> None:
        if name in self._later:
            number, rows = self._later[name]
            new = rows()
            with settings(self.spark, {CLEANUP: "true"}):
                self._write(name, number, new)
            del self._later[name]

    def first(self, name: str) -> DataFrame:
        """A table's rows in the first of the layers that count."""
        self._lay(name)
        return self.spark.read.schema(self.layouts[name].schema).parquet(f"{self.folder}/{name}/{LAYER}={self.committed()[0]}")

    def _delete_before(self, number: int) -> None:
        for name in self.layouts:
            for old in range(1, number):
                files, path = self._path(name, f"{LAYER}={old}")
                files.delete(path, True)

    def every(self, name: str) -> DataFrame:
        """The rows of all layers, with the number of theirs."""
        self._lay(name)
        schema = StructType([*self.layouts[name].schema.fields, StructField(LAYER, IntegerType())])
        at = [f"{self.folder}/{name}/{LAYER}={n}" for n in self.committed()]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*at)

    def live(self, name: str, where: Column | None = None, keep_layer: bool = False) -> DataFrame:
        """The rows that count (and meet a condition, which is pushed to the files); sums by key."""
        layout, rows = self.layouts[name], self.every(name)
        rows = rows if where is None else rows.where(where)
        if layout.sums:
            summed = rows.groupBy(*layout.key).agg(*(F.sum(c).alias(c) for c in layout.sums))
            return summed.where(" OR ".join(f"{c} <> 0" for c in layout.sums)).select(*layout.schema.names)
        if len(self.committed()) > 1:
            last = self.every(GONE).groupBy(F.col("file").alias("gone_file")).agg(F.max(LAYER).alias("gone_by"))
            rows = rows.join(last, F.col("file") == F.col("gone_file"), "left").where(F.col("gone_by").isNull() | (F.col("gone_by") <= F.col(LAYER)))
        return rows.select(*layout.schema.names, *([LAYER] if keep_layer else []))

    def compact(self, renumbered: dict[str, DataFrame] | None = None) -> None:
        """Writes all that counts as one layer. renumbered: tables that cannot be taken over as they are."""
        self.add({name: self.live(name) for name in self.layouts if name != GONE} | (renumbered or {}), base=True)
