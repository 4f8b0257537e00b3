"""Tables in versions: new files are written first, then one small pointer file is put in place that names every table's files.

A pointer is `{path}/_versions/{number}.json`, put in place whole and only where no pointer of that number is: of two writers that start
from one version the second fails (Conflict), and what a killed writer left is named by no pointer, so nobody reads it. Since a pointer
covers all tables of the folder, a change of several tables is seen as a whole or not at all.

Tables with a key are kept in parts (a hash of the key). A change of some parts writes those anew and goes on naming the files of the
others. The store must refuse to rename over an existing file, as HDFS does; local folders are linked instead.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTERS, PART = "_versions", "_galley_part"
#: Parts of a table with a key.
PARTS = 64


class Conflict(RuntimeError):
    """Another writer has made the version that was to be made."""


@dataclass(frozen=True)
class Version:
    number: int
    writer: str
    #: name -> schema (JSON), key, parts, folders: lists of folders below the path, by part ("" without a key)
    tables: dict[str, dict]


@dataclass(frozen=True)
class Change:
    """New rows of one table: of all of it, of the parts in `touched`, or more rows if `append`."""

    rows: DataFrame
    key: str | None = None
    parts: int = PARTS
    touched: list[int] | None = None
    append: bool = False


@dataclass
class Tables:
    """The tables in a folder that all executors share."""

    spark: SparkSession
    path: str
    _fs: object = field(default=None, repr=False)

    def __post_init__(self):
        self.path = self.path.rstrip("/")
        self._fs = self._at("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        """The numbers of all versions that are in place, ascending."""
        if not self._fs.exists(self._at(POINTERS)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(POINTERS))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def current(self) -> Version | None:
        numbers = self.numbers()
        return self.version(numbers[-1]) if numbers else None

    def version(self, number: int) -> Version:
        stream = self._fs.open(self._at(f"{POINTERS}/{number}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, **json.loads(text))

    def read(self, name: str, version: Version | None = None, parts: list[int] | None = None) -> DataFrame:
        """A table of the newest or the given version, or only some of its parts: other parts' files aren't opened."""
        version = version or self.current()
        table = version.tables[name]
        schema = StructType.fromJson(json.loads(table["schema"]))
        chosen = table["folders"] if parts is None else {str(p): table["folders"].get(str(p), []) for p in parts}
        folders = [f"{self.path}/{f}" for fs in chosen.values() for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def parts_of(self, name: str, keys: DataFrame, version: Version | None = None) -> list[int]:
        """The parts that hold the keys in the only column of keys: as many numbers as the table has parts, at most."""
        table = (version or self.current()).tables[name]
        kind = StructType.fromJson(json.loads(table["schema"]))[table["key"]].dataType
        part = F.pmod(F.xxhash64(F.col(keys.columns[0]).cast(kind)), F.lit(table["parts"])).cast("int")
        return sorted(r[0] for r in keys.select(part).distinct().collect())

    def commit(self, changes: dict[str, Change], expected: int, writer: str) -> Version:
        """Version expected + 1 with the changes; expected is the number of the version that they were made from, -1 of none.

        A writer that has made this very version before, as a repeated batch has, gets that one.
        """
        base = self.current()
        if base and base.number == expected + 1 and base.writer == writer:
            return base
        if (base.number if base else -1) != expected:
            raise Conflict(f"made from version {expected}, but {base.number if base else 'none'} is the newest")
        tables = dict(base.tables) if base else {}
        for name, change in changes.items():
            tables[name] = self._stage(name, change, tables.get(name))
        self._put(expected + 1, json.dumps({"writer": writer, "tables": tables}))
        return Version(expected + 1, writer, tables)

    def _stage(self, name: str, change: Change, old: dict | None) -> dict:
        folder, rows = f"{name}/{uuid.uuid4().hex}", change.rows
        key, parts = (old["key"], old["parts"]) if old and (change.append or change.touched is not None) else (change.key, change.parts)
        if key is None:
            rows.write.parquet(f"{self.path}/{folder}")
            new = {"": [folder]}
        else:
            part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")
            rows.withColumn(PART, part).hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
            made = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder)) if s.isDirectory()]
            new = {d.split("=")[1]: [f"{folder}/{d}"] for d in made if d.startswith(f"{PART}=")}
        if old and change.append:
            new = {p: old["folders"].get(p, []) + new.get(p, []) for p in old["folders"].keys() | new.keys()}
        elif old and change.touched is not None:
            stray = new.keys() - {str(p) for p in change.touched}
            if stray:
                raise ValueError(f"rows of {name} outside the touched parts: {sorted(stray)}")
            new = {p: fs for p, fs in old["folders"].items() if int(p) not in change.touched} | new
        return {"schema": rows.schema.json(), "key": key, "parts": parts, "folders": new}

    def _put(self, number: int, text: str) -> None:
        """The pointer in place, whole, unless there is one already."""
        jvm, target = self.spark._jvm, self._at(f"{POINTERS}/{number}.json")
        draft = self._at(f"{POINTERS}/{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if draft.getFileSystem(self._fs.getConf()).getUri().getScheme() == "file":
                local = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.String, 0))
                jvm.java.nio.file.Files.createLink(local(target), local(draft))
                self._fs.delete(draft, False)
            else:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._fs.getConf()).rename(draft, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            if not self._fs.exists(target):
                raise
            raise Conflict(f"version {number} has been made meanwhile") from error
        finally:
            self._fs.delete(draft, False)

    def vacuum(self, keep: int = 7, older_than_ms: int = 86_400_000) -> list[str]:
        """Deletes pointers but the last `keep`, and folders that these don't name and that are old enough to be no one's work in progress."""
        numbers = self.numbers()
        named = {f.split("/")[1] for n in numbers[-keep:] for t in self.version(n).tables.values() for fs in t["folders"].values() for f in fs}
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"{POINTERS}/{n}.json"), False)
        before, gone = self.spark._jvm.java.lang.System.currentTimeMillis() - older_than_ms, []
        for table in [s for s in self._fs.listStatus(self._at("")) if s.isDirectory() and s.getPath().getName() != POINTERS]:
            for folder in self._fs.listStatus(table.getPath()):
                if folder.getPath().getName() not in named and folder.getModificationTime() <= before:
                    self._fs.delete(folder.getPath(), True)
                    gone.append(folder.getPath().getName())
        return gone


def changed_parts(tables: Tables, name: str, keys: DataFrame, change, base: Version | None = None) -> Change:
    """The change of the parts of a table that hold keys: change is applied to the rows of these parts and to no others."""
    base = base or tables.current()
    touched = tables.parts_of(name, keys, base)
    return Change(change(tables.read(name, base, touched)), touched=touched)
