"""Where statements are kept: open_store(url) by scheme. All have read(); those that can change have commit(change)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.store import KEYS, Store, Triggers
from . import formats
from .statements import COLUMNS, SCHEMA, scan
from .tables import stored


class MemStore:
    """Statements of this session."""

    def __init__(self, spark: SparkSession, df: DataFrame | None = None):
        self.df = spark.createDataFrame([], SCHEMA) if df is None else df

    def read(self) -> DataFrame:
        return self.df

    def commit(self, change) -> None:
        self.df = change(self.df)


class FileStore:
    """Files of one of the formats, read as a whole and written as a whole to a new folder, which then takes the old one's
    place."""

    def __init__(self, spark: SparkSession, path: str, kind: str | None = None):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind or formats.sniff(path)

    def read(self) -> DataFrame:
        return formats.read(self.spark, self.path, self.kind)

    def commit(self, change) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        new, old = path(self.path + ".new"), path(self.path + ".old")
        formats.write(change(self.read()), self.path + ".new", self.kind)
        fs.delete(old, True)
        if fs.exists(path(self.path)):
            fs.rename(path(self.path), old)
        fs.rename(new, path(self.path))
        fs.delete(old, True)


class LogStore:
    """An append-only log of N-Triples: each commit is a folder of lines to add and, after '#!remove', to remove. Folders are
    written beside the log and renamed into it, so that a commit is seen whole or not; reading replays them in order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def commits(self) -> list[str]:
        fs, path = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(path(self.folder))] if fs.exists(path(self.folder)) else []
        return sorted(n for n in names if n.startswith("log-"))

    def read(self, last: int | None = None) -> DataFrame:
        done = self.commits()[: None if last is None else last + 1]
        if not done:
            return self.spark.createDataFrame([], SCHEMA)
        return formats.read_ntriples(self.spark, [f"{self.folder}/{n}" for n in done])

    def commit(self, change) -> int:
        old = self.read()
        new = stored(change(old))
        added, removed = new.join(old, KEYS, "left_anti"), old.join(new, KEYS, "left_anti")
        rows = removed.select(*KEYS, F.lit("remove").alias("op")).unionByName(added.select(*KEYS, F.lit("add").alias("op")))
        v = len(self.commits())
        at = f"{self.folder}/new-{uuid.uuid4().hex}"
        # removals first: a statement that only changed its context is removed and added
        formats.write_ntriples(rows.repartitionByRange(8, F.desc("op")).sortWithinPartitions(F.desc("op")), at)
        fs, path = self._fs()
        to = path(f"{self.folder}/log-{v:08d}")
        if fs.exists(to) or not fs.rename(path(at), to):
            raise RuntimeError(f"commit {v} was made by another writer")
        return v


class IndexedStore:
    """Statements laid out twice: by predicate, sorted by object, and by ranges of subjects. A scan reads the layout that its
    slots prune: folders of a predicate and the object's row groups, or the subject's files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, change) -> None:
        new = stored(change(self.read()))
        at = f"{self.folder}/{uuid.uuid4().hex}"
        new.repartition("predicate", F.pmod(F.xxhash64("object"), F.lit(8))).sortWithinPartitions("predicate", "object").write.partitionBy("predicate").parquet(f"{at}/by_predicate")
        new.repartitionByRange("subject", "predicate").sortWithinPartitions("subject", "predicate").write.parquet(f"{at}/by_subject")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(path(f"{self.folder}/current"), True)
        out.write(bytearray(at.encode()))
        out.close()

    def _at(self) -> str | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.text(f"{self.folder}/current").first()[0] if fs.exists(path(f"{self.folder}/current")) else None

    def read(self) -> DataFrame:
        at = self._at()
        return self.spark.read.schema(SCHEMA).parquet(f"{at}/by_subject") if at else self.spark.createDataFrame([], SCHEMA)

    def scan(self, subject=None, predicate=None, obj=None, objecttype=None, context=None, **hints) -> DataFrame:
        at = self._at()
        if not at or subject is not None or predicate is None:
            return scan(self.read(), subject, predicate, obj, objecttype, context, **hints)
        rows = self.spark.read.schema(SCHEMA).parquet(f"{at}/by_predicate").select(*COLUMNS)
        return scan(rows, None, predicate, obj, objecttype, context, **hints)


class TableStore:
    """Statements of a database table, over JDBC or of an SQLite file."""

    def __init__(self, df: DataFrame):
        self.df = df

    def read(self) -> DataFrame:
        have = self.df.columns
        return self.df.selectExpr(*[c if c in have else f"cast(null as {'array<int>' if c == 'listpos' else 'string'}) as {c}" for c in COLUMNS])


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.parts = options["path"], options.get("dbtable", "statements"), int(options.get("parts", "8"))
        self.names = schema.fieldNames()

    def _run(self, sql: str, *args):
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(sql, args)

    def partitions(self) -> list[Rows]:
        first, last = next(self._run(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{self.table}"'))
        step = max(1, -(-(last - first + 1) // self.parts))
        return [Rows(a, min(a + step - 1, last)) for a in range(first, last + 1, step)] or [Rows(0, -1)]

    def read(self, partition: Rows):
        cols = ", ".join(f'cast("{n}" as text)' for n in self.names)
        yield from self._run(f'select {cols} from "{self.table}" where rowid between ? and ?', partition.first, partition.last)


class SqliteSource(DataSource):
    """spark.read.format('statements_sqlite'): a table of texts of an SQLite file that every machine sees, by ranges of rows."""

    @classmethod
    def name(cls) -> str:
        return "statements_sqlite"

    def schema(self) -> str:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            names = [r[1] for r in con.execute(f"pragma table_info(\"{self.options.get('dbtable', 'statements')}\")")]
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str = "statements") -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("statements_sqlite").option("path", path).option("dbtable", table).load()


def read_jdbc(spark: SparkSession, url: str, table: str = "statements", column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options) -> DataFrame:
    """A table over JDBC; with a numeric column and its bounds, in parts. The driver must be on Spark's class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def _folder(spark: SparkSession, url: str, triggers: Triggers | None):
    parts = urlsplit(url)
    return Store(spark, parts._replace(scheme="file" if parts.scheme == "versions" else parts.scheme, query="").geturl(), triggers)


def _file(spark: SparkSession, url: str, triggers: Triggers | None):
    parts = urlsplit(url)
    known = any(parts.path.rstrip("/").endswith(x) for x in formats.EXTENSIONS)
    return FileStore(spark, parts._replace(query="").geturl(), parse_qs(parts.query).get("format", [None])[0]) if known or parts.query else _folder(spark, url, triggers)


def _sqlite(spark: SparkSession, url: str, triggers: Triggers | None):
    parts = urlsplit(url)
    return TableStore(read_sqlite(spark, parts.path, parse_qs(parts.query).get("table", ["statements"])[0]))


#: Scheme to an opener; register more by adding to it. Other schemes are folders of versions where Spark reads and writes.
SCHEMES: dict[str, Callable] = {
    "mem": lambda spark, url, triggers: MemStore(spark),
    "file": _file,
    "versions": _folder,
    "log": lambda spark, url, triggers: LogStore(spark, urlsplit(url)._replace(scheme="file").geturl()),
    "indexed": lambda spark, url, triggers: IndexedStore(spark, urlsplit(url)._replace(scheme="file").geturl()),
    "sqlite": _sqlite,
    "jdbc": lambda spark, url, triggers: TableStore(read_jdbc(spark, url)),
}


def open_store(spark: SparkSession, url: str, triggers: Triggers | None = None):
    """The store of a URL: mem:, file:///x.nt (a file of statements), versions:///folder, log:///folder, indexed:///folder, sqlite:///file?table=t, jdbc:.."""
    scheme = urlsplit(url).scheme
    if not scheme:
        raise ValueError(f"{url!r} has no scheme")
    return SCHEMES.get(scheme, _folder)(spark, url, triggers)
