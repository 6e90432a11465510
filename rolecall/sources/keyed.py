"""Stored tables that a merge rewrites in part.

A table is cut into parts by a hash of its key columns, one folder for each part.
A batch reads the parts its keys fall in, and the folders of the merged parts are
moved to the place of the old ones; all other files stay as they are.

A batch is stored once, and large parts are merged one after another, each with its
own rows of the batch. The shuffle files of one are deleted before the next, so the
disk holds those of one part and not of the whole table.

A merge is first written beside the table and then published, so a run that ends
in between can be started again: a finished write is published once more instead
of folding the batch into a table that already holds half of it.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, NullType, StringType, StructField, StructType

from rolecall.session import new_folder, shuffles_dropped

PART = "_part"
#: Bytes of stored rows and batch from which on parts are merged by themselves; smaller ones are merged together.
AT_ONCE = 32 << 20
#: Bytes of a file of a large part, about.
FILE = 64 << 20


@dataclass(frozen=True)
class KeyedTable:
    """A table in a shared folder, cut into ``parts`` by its ``keys``.

    A merge may change rows only together with batch rows of the same keys, so
    the keys are those of the merge or some of them. Columns named ``_part`` are
    the table's own.
    """

    folder: str
    keys: tuple[str, ...]
    schema: StructType
    parts: int = 256

    def _part(self):
        # keys are hashed as the table stores them, whatever type a batch has them in
        return F.pmod(F.xxhash64(*[F.col(k).cast(self.schema[k].dataType) for k in self.keys]),
                      F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Rows by part, in place of a whole folder; adaptive execution splits what small parts have together.

        Rows are stored first, in the order of parts; a large part is then read by tasks of its own and not shuffled.
        """
        given = StoredRows(self, rows.select(*self.schema.names), f"{folder}-rows")
        # two tasks at least, as Spark reads a union of single tasks in one
        pieces = [self._filed(given.read(some)) if len(some) > 1 else
                  given.read(some).coalesce(2 + size // FILE).withColumn(PART, self._part())
                  for some, size in groups(given.sizes())]
        rows = reduce(DataFrame.unionByName, pieces or [self._filed(given.read([]))])
        with shuffles_dropped(given.spark):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option(
                "compression", "zstd").partitionBy(PART).parquet(folder)
        given.drop()

    def _filed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names).withColumn(PART, self._part()).hint("rebalance", PART)

    def _read(self, spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.schema(StructType([*self.schema, StructField(PART, IntegerType())])).parquet(folder)

    def create(self, rows: DataFrame) -> "KeyedTable":
        """Store the first rows; an existing table is never replaced."""
        path, files = _files(rows.sparkSession, self.folder)
        if files.exists(path):
            raise FileExistsError(self.folder)
        self._write(rows, self.folder)
        return self

    def read(self, spark: SparkSession, parts: list[int] | None = None) -> DataFrame:
        """The table, or the given parts of it alone; no other file is opened."""
        stored = self._read(spark, self.folder)
        rows = stored if parts is None else stored.where(F.col(PART).isin(parts))
        return rows.drop(PART)

    def touched(self, batch: DataFrame) -> list[int]:
        """The parts that the keys of a batch fall in, ``parts`` numbers at most."""
        return sorted(r[0] for r in batch.select(self._part()).distinct().collect())

    def merge(self, batch: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame],
              epoch: int | None = None) -> list[int]:
        """Replace the touched parts by ``fold(their rows, batch)``; the touched parts.

        Of large parts, ``fold`` is given one after another, each with the rows of the
        batch whose keys fall in it.

        ``epoch`` numbers the batches of a stream: one that is already in the table
        is left out, and one whose merge was cut off is taken up again.
        """
        spark = batch.sparkSession
        name = "batch" if epoch is None else str(epoch)
        pending, files = _files(spark, f"{self.folder}-pending/{name}")
        if epoch is not None and files.exists(_path(spark, f"{self.folder}-done/{name}")):
            return []
        # a finished merge needs its parts alone
        written = epoch is not None and files.exists(_path(spark, f"{pending}/_SUCCESS"))
        given = None if written else StoredRows(self, batch, f"{self.folder}-batch/{name}")
        parts = self.touched(batch) if written else sorted(given.rows_of)
        if not parts:
            if given:
                given.drop()
            return []
        if epoch is None and files.exists(_path(spark, f"{pending}/_listed/_SUCCESS")):
            self._publish(spark, str(pending), [])  # a merge cut off between two parts; none of them is lost
        if not written:
            files.delete(pending, True)
            self._fold(given, fold, str(pending))
            given.drop()
        self._publish(spark, str(pending), parts)
        if epoch is not None:
            files.mkdirs(_path(spark, f"{self.folder}-done/{name}"))
            files.delete(_path(spark, f"{self.folder}-done/{epoch - 1}"), True)
        files.delete(pending, True)
        return parts

    def _fold(self, given: "StoredRows", fold: Callable[[DataFrame, DataFrame], DataFrame], folder: str) -> None:
        """Write the merged parts into a folder; it is marked when all of them are there."""
        spark = given.spark
        stored, sizes = self._read(spark, self.folder), given.sizes()
        for p in sizes:
            path, files = _files(spark, f"{self.folder}/{PART}={p}")
            sizes[p] += files.getContentSummary(path).getLength() if files.exists(path) else 0
        for some, _ in groups(sizes):
            rows = fold(stored.where(F.col(PART).isin(some)).drop(PART), given.read(some)).select(*self.schema.names)
            # a part by itself needs no shuffle to be filed
            rows = self._filed(rows) if len(some) > 1 else rows.withColumn(PART, self._part())
            with shuffles_dropped(spark):
                rows.write.mode("append").option("compression", "zstd").option(
                    "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(PART).parquet(folder)
        path, files = _files(spark, f"{folder}/_SUCCESS")
        files.mkdirs(path)

    def _publish(self, spark: SparkSession, pending: str, parts: list[int]) -> None:
        """Move the written parts to the place of the old ones, and drop those left empty; no row is written again.

        Which parts are written is listed before any is moved, so that a publication can be taken up again.
        """
        listed, files = _files(spark, f"{pending}/_listed")
        if not files.exists(_path(spark, f"{listed}/_SUCCESS")):
            for p in parts:
                full = files.exists(_path(spark, f"{pending}/{PART}={p}"))
                files.mkdirs(_path(spark, f"{listed}/{'full' if full else 'empty'}={p}"))
            files.mkdirs(_path(spark, f"{listed}/_SUCCESS"))
        for name in [x.getPath().getName() for x in files.listStatus(listed)]:
            kind, _, p = name.partition("=")
            new, old = _path(spark, f"{pending}/{PART}={p}"), _path(spark, f"{self.folder}/{PART}={p}")
            if kind == "empty" or kind == "full" and files.exists(new):
                files.delete(old, True)
            if kind == "full" and files.exists(new) and not files.rename(new, old):
                raise OSError(f"{new} could not be moved")


class StoredRows:
    """Rows stored once, in the order of the parts of a table, so that reading a part passes over most of the rest."""

    def __init__(self, table: KeyedTable, batch: DataFrame, folder: str):
        self.spark, self.folder = batch.sparkSession, folder
        rows = batch.withColumn(PART, table._part())
        # no file holds a column without a type
        self.void = [f.name for f in batch.schema if isinstance(f.dataType, NullType)]
        self.schema = StructType([StructField(f.name, StringType()) if f.name in self.void else f for f in rows.schema])
        rows = rows.withColumns({n: F.col(n).cast("string") for n in self.void})
        with shuffles_dropped(self.spark):
            rows.sortWithinPartitions(PART).write.mode("overwrite").option("compression", "zstd").parquet(folder)
            self.rows_of = {r[PART]: r["count"] for r in self._stored().groupBy(PART).count().collect()}

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def read(self, parts: list[int]) -> DataFrame:
        rows = self._stored().where(F.col(PART).isin(parts)).drop(PART)
        return rows.withColumns({n: F.lit(None) for n in self.void})

    def sizes(self) -> dict[int, int]:
        """About how many bytes each part takes, in the order of the parts."""
        path, files = _files(self.spark, self.folder)
        total, n = files.getContentSummary(path).getLength(), max(1, sum(self.rows_of.values()))
        return {p: total * self.rows_of[p] // n for p in sorted(self.rows_of)}

    def drop(self) -> None:
        path, files = _files(self.spark, self.folder)
        files.delete(path, True)


def groups(sizes: dict[int, int]) -> list[tuple[list[int], int]]:
    """Parts that are worked on together, in order, and their bytes: a large part is by itself."""
    out = []
    for p, size in sizes.items():
        if out and out[-1][1] + size <= AT_ONCE:
            out[-1] = ([*out[-1][0], p], out[-1][1] + size)
        else:
            out.append(([p], size))
    return out


def merged_in_parts(rows: DataFrame, batch: DataFrame, keys: list[str],
                    fold: Callable[[DataFrame, DataFrame], DataFrame], parts: int) -> DataFrame:
    """``fold(rows, batch)``, worked out one after another for parts by a hash of the keys, in the shared folder.

    Rows and batch are stored once, so what they are made from is read once and shuffled once.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "merged")
    table = KeyedTable(folder, tuple(keys), rows.schema, parts)
    stored, given = StoredRows(table, rows, f"{folder}-rows"), StoredRows(table, batch, f"{folder}-batch")
    sizes = [stored.sizes(), given.sizes()]
    both = {p: sum(x.get(p, 0) for x in sizes) for p in sorted({*sizes[0], *sizes[1]})}
    for some, _ in groups(both) or [([0], 0)]:
        with shuffles_dropped(spark):
            fold(stored.read(some), given.read(some)).write.mode("append").option("compression", "zstd").parquet(folder)
    stored.drop()
    given.drop()
    return spark.read.schema(rows.schema).parquet(folder)


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):
    """A path, and the file system it is in."""
    path = _path(spark, name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())
