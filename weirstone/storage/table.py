"""Versioned tables of plain Parquet: immutable folders and a log of manifests.

``<table>/snap=<id>/`` holds files; ``<table>/_log/<n>.json`` lists the folders that make up version n.
A commit creates the next manifest exclusively, and tries again on top of a rival's. Nothing that a
version lists is ever rewritten, so a plan may read a table while it is written. All file work goes
through the Hadoop file system of the session, so any store that Spark writes will do.

A table may be laid out by buckets of its keys. Its folders are then ``snap=<id>/_bucket=<n>``, and a
merge reads and writes only the buckets that source rows fall in.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.operators.merge import AmbiguousMerge, ambiguous_keys, insert_absent, upsert

#: Seconds after which the claim of a writer that never finished its commit no longer counts.
CLAIM_S = 60

#: Seconds for which vacuum leaves what no version lists: a writer may be about to commit it.
UNLISTED_S = 24 * 3600

#: Versions whose manifests are kept at least, and how often older ones are removed.
KEPT_VERSIONS, PRUNE_EVERY = 256, 64

#: Buckets of a table that is laid out by keys; folders of one size that are gathered into one.
BUCKETS, GATHER = 64, 64

BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another writer replaced what this one built upon."""


@dataclass(frozen=True)
class Layout:
    """Rows by a hash of their keys."""

    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Version:
    number: int
    snapshots: list[str]
    schema: str
    marks: dict[str, int] = field(default_factory=dict)
    layout: Layout | None = None
    added: list[str] = field(default_factory=list)

    @property
    def fields(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class Files:
    """The few file operations that a table needs, on the session's Hadoop file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name) if name else self.root

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether this call created the file; never overwrites. The content is complete once it has its name.

        An exclusive claim decides among rivals, since a rename would replace on some stores. A claim
        whose owner is gone is lifted after ``CLAIM_S`` seconds.
        """
        if self.fs.exists(self.path(name)):
            return False
        claim = self.path(f"{name}.claim")
        try:
            self.fs.create(claim, False).close()
        except Py4JJavaError:
            if self.fs.exists(claim) and self.age(f"{name}.claim") > CLAIM_S and not self.fs.exists(self.path(name)):
                self.fs.delete(claim, False)
            time.sleep(0.2)
            return False
        draft = f"_log/.{uuid.uuid4().hex}"
        self.write(draft, text)
        return bool(self.fs.rename(self.path(draft), self.path(name)))

    def bytes(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def age(self, name: str) -> float:
        """Seconds since the last modification."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} can't be named {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Log:
    """Numbered JSON files, each created once; the old ones go as new ones come."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, str(path), Files(spark, str(path))

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("_log") if n.endswith(".json")]

    def entry(self, number: int) -> dict:
        return json.loads(self.files.read(f"_log/{number:012d}.json"))

    def add(self, number: int, entry: dict) -> bool:
        made = self.files.create(f"_log/{number:012d}.json", json.dumps(entry))
        if made and number % PRUNE_EVERY == 0:
            for name in self.files.names("_log"):
                if name[:12].isdigit() and int(name[:12]) <= number - KEPT_VERSIONS:
                    self.files.delete(f"_log/{name}")
        return made


class Table(Log):
    def latest(self) -> Version | None:
        numbers = self.numbers()
        return self.version(numbers[-1]) if numbers else None

    def version(self, number: int) -> Version:
        raw = self.entry(number)
        layout = raw.get("layout")
        return Version(number, raw["snapshots"], raw["schema"], raw["marks"], layout and Layout(tuple(layout["keys"]), layout["buckets"]), raw.get("added", []))

    def exists(self) -> bool:
        return self.latest() is not None

    def _rows(self, held: Version, snapshots: Sequence[str]) -> DataFrame:
        """The rows of some of a version's folders; columns that a folder lacks are null."""
        if not snapshots:
            return self.spark.createDataFrame([], held.fields)
        # The declared schema makes a merge of all files' footers needless.
        return self.spark.read.schema(held.fields).option("basePath", self.path).parquet(*(f"{self.path}/{s}" for s in snapshots)).select(*(f"`{n}`" for n in held.fields.names))

    def _held(self, version: int | None) -> Version:
        held = self.latest() if version is None else self.version(version)
        if held is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return held

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the latest or given version."""
        held = self._held(version)
        return self._rows(held, held.snapshots)

    def bytes(self, version: int | None = None) -> int:
        """Of the files that a version lists."""
        return sum(self.files.bytes(s) for s in self._held(version).snapshots)

    def read_added(self, version: int | None = None) -> DataFrame:
        """The rows that the latest or given version added or wrote anew."""
        held = self._held(version)
        return self._rows(held, held.added)

    def _write(self, rows: DataFrame, partition_by: Sequence[str] = (), layout: Layout | None = None, level: int = 0) -> list[str]:
        """Write rows to a new folder; what a version lists of it. The first number of its name says how often its rows were gathered."""
        name = f"snap={level}-{uuid.uuid4().hex}"
        if layout is None:
            rows.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
            return [name]
        # Rebalanced, so that a bucket is one file unless it is large.
        laid = rows.withColumn(BUCKET, layout.bucket()).hint("rebalance", BUCKET)
        laid.write.partitionBy(BUCKET, *partition_by).parquet(f"{self.path}/{name}")
        return [f"{name}/{n}" for n in self.files.names(name) if n.startswith(f"{BUCKET}=")]

    def _commit(self, build: Callable[[Version | None], Version | None], mark: tuple[str, int] | None = None) -> Version | None:
        """Publish ``build(latest)``; nothing if a rival has committed the same mark, or there is nothing to publish."""
        while True:
            base = self.latest()
            marks = dict(base.marks) if base else {}
            if mark and marks.get(mark[0], -1) >= mark[1]:
                return None
            made = build(base)
            if made is None:
                return None
            if mark:
                marks[mark[0]] = mark[1]
            number = (base.number if base else 0) + 1
            entry = {"snapshots": made.snapshots, "schema": made.schema, "marks": marks, "layout": made.layout and asdict(made.layout), "added": made.added}
            if self.add(number, entry):
                return Version(number, made.snapshots, made.schema, marks, made.layout, made.added)

    def _unmoved(self, base: Version | None, on: Version | None) -> None:
        if (base.number if base else 0) != (on.number if on else 0):
            raise CommitConflict(f"{self.path} moved from {on and on.number} to {base and base.number}")

    def seen(self, mark: tuple[str, int]) -> bool:
        """Whether a batch (query id, number) was committed before."""
        held = self.latest()
        return bool(held and held.marks.get(mark[0], -1) >= mark[1])

    def _joined(self, base: Version, schema: T.StructType) -> T.StructType:
        """A version's fields and those that rows of the given schema add to them."""
        held = base.fields
        for new in schema:
            if new.name not in held.names:
                held = T.StructType([*held.fields, T.StructField(new.name, new.dataType, True)])
            elif held[new.name].dataType != new.dataType:
                raise TypeError(f"{self.path}: {new.name} is {held[new.name].dataType.simpleString()}, not {new.dataType.simpleString()}")
        return held

    def append(self, rows: DataFrame, partition_by: Sequence[str] = (), mark: tuple[str, int] | None = None) -> Version | None:
        """Add rows; new columns join the schema. With a mark that was seen, nothing happens."""
        if mark and self.seen(mark):
            return None
        base = self.latest()
        layout = base.layout if base else None
        added = self._write(rows, partition_by, layout)

        def build(base: Version | None) -> Version:
            if (base.layout if base else None) != layout:
                raise CommitConflict(f"{self.path} has another layout now")
            if base is None:
                return Version(0, added, rows.schema.json(), added=added)
            return Version(0, [*base.snapshots, *added], self._joined(base, rows.schema).json(), layout=layout, added=added)

        return self._commit(build, mark)

    def overwrite(self, rows: DataFrame, partition_by: Sequence[str] = (), on: Version | None | bool = False, layout: Layout | None = None) -> Version:
        """Replace rows and schema. With ``on``, only if that is still the latest version."""
        added = self._write(rows, partition_by, layout)

        def build(base: Version | None) -> Version:
            if on is not False:
                self._unmoved(base, on)
            return Version(0, added, rows.schema.json(), layout=layout, added=added)

        return self._commit(build)

    def _touched(self, source: DataFrame, base: Version | None, layout: Layout) -> tuple[list[str], list[str]]:
        """(folders of the buckets that source rows fall in, the other folders); the driver gets at most one number a bucket."""
        if base is None or base.layout != layout:
            return (base.snapshots if base else []), []
        numbers = {r[0] for r in source.select(layout.bucket().alias("b")).distinct().collect()}
        inside = [s for s in base.snapshots if int(s.rsplit("=", 1)[1]) in numbers]
        return inside, [s for s in base.snapshots if s not in set(inside)]

    def _staged(self, source: DataFrame, base: Version | None, keys: Sequence[str]) -> tuple[DataFrame, str]:
        """A merge's source written once, with its keys in the table's types; and its folder."""
        if base:
            held = base.fields
            source = source.withColumns({k: F.col(k).cast(held[k].dataType) for k in keys if source.schema[k].dataType != held[k].dataType})
        name = f"_staged/{uuid.uuid4().hex}"
        source.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(source.schema).parquet(f"{self.path}/{name}"), name

    def merge(self, source: DataFrame, keys: Sequence[str], update: Sequence[str], buckets: int | None = None) -> int:
        """Refresh ``update`` columns of rows with the same keys, insert the others; the number of source rows.

        The table is laid out by ``keys`` from its first merge on. Later merges by the same keys leave
        the folders of buckets without source rows as they are.
        """
        base = self.latest()
        laid = base.layout if base and base.layout and base.layout.keys == tuple(keys) and buckets in (None, base.layout.buckets) else None
        layout = laid or Layout(tuple(keys), buckets or BUCKETS)
        source, staged = self._staged(source, base, keys)
        try:
            if twice := ambiguous_keys(source, keys).limit(1).collect():
                raise AmbiguousMerge(f"{self.path}: source key {twice[0]}")
            inside, outside = self._touched(source, base, layout)
            rows = upsert(self._rows(base, inside), source, keys, update) if base else source
            added = self._write(rows, (), layout)

            def build(now: Version | None) -> Version:
                self._unmoved(now, base)
                return Version(0, [*outside, *added], rows.schema.json(), layout=layout, added=added)

            self._commit(build)
            return source.count()
        finally:
            self.files.delete(staged)

    def merge_absent(self, source: DataFrame, keys: Sequence[str]) -> int:
        """Insert the rows whose keys are new; the number of distinct source keys. Of a table that is laid out by these keys, only buckets with source rows are read."""
        base = self.latest()
        source, staged = self._staged(source.dropDuplicates(list(keys)), base, keys)
        try:
            if base is None:
                self.overwrite(source, on=None, layout=Layout(tuple(keys)))
            else:
                layout = base.layout if base.layout and base.layout.keys == tuple(keys) else None
                inside = self._touched(source, base, layout)[0] if layout else base.snapshots
                added = self._write(insert_absent(self._rows(base, inside), source, keys), (), base.layout)

                def build(now: Version | None) -> Version:
                    self._unmoved(now, base)
                    return Version(0, [*base.snapshots, *added], self._joined(base, source.schema).json(), layout=base.layout, added=added)

                self._commit(build)
            return source.count()
        finally:
            self.files.delete(staged)

    def gather(self, most: int = GATHER, partition_by: Sequence[str] = ()) -> bool:
        """Write folders of small appends as one, as long as there are ``most`` of one level; whether there were. Each row is written again once a level."""
        done = False
        while (base := self.latest()) and not base.layout:
            levels: dict[int, list[str]] = {}
            for s in base.snapshots:
                levels.setdefault(int(s.removeprefix("snap=").split("-")[0]), []).append(s)
            full = [(level, names) for level, names in sorted(levels.items()) if len(names) >= most]
            if not full:
                break
            level, names = full[0]
            made, gone = self._write(self._rows(base, names), partition_by, level=level + 1), set(names)

            def build(now: Version | None, made: list[str] = made, gone: set[str] = gone) -> Version | None:
                if now is None or not gone <= set(now.snapshots):
                    return None
                return Version(0, [*made, *(s for s in now.snapshots if s not in gone)], now.schema, layout=now.layout)

            if self._commit(build) is None:
                break
            done = True
        return done

    def vacuum(self, keep: int = 1, unlisted_s: float = UNLISTED_S) -> list[str]:
        """Delete folders that none of the last ``keep`` versions lists; their names.

        What was written within ``unlisted_s`` seconds stays: a writer may not have committed it yet.
        """
        used = {s.split("/")[0] for n in self.numbers()[-keep:] for s in self.version(n).snapshots}
        loose = [n for n in self.files.names("") if n.startswith("snap=") and n not in used]
        loose += [f"_staged/{n}" for n in self.files.names("_staged")]
        gone = [n for n in loose if self.files.age(n) >= unlisted_s]
        for name in gone:
            self.files.delete(name)
        return gone


class Group(Log):
    """Tables below one folder whose versions readers see together.

    An entry of the log names a version of each table. Writers first commit to the tables and then
    enter the versions; until then no reader of the group sees any of them.
    """

    def latest(self) -> dict:
        numbers = self.numbers()
        return self.entry(numbers[-1]) if numbers else {"tables": {}, "marks": {}, "settled": None}

    def seen(self, mark: tuple[str, int]) -> bool:
        return self.latest()["marks"].get(mark[0], -1) >= mark[1]

    def publish(self, versions: dict[str, int], mark: tuple[str, int] | None = None, settled: str | None = None) -> None:
        """Enter new versions of some tables, and the batch they come from; ``settled``: the query that has been through all that the source held."""
        while True:
            numbers, held = self.numbers(), self.latest()
            tables = {name: max(held["tables"].get(name, 0), versions.get(name, 0)) for name in {*held["tables"], *versions}}
            marks = held["marks"] | ({mark[0]: max(mark[1], held["marks"].get(mark[0], -1))} if mark else {})
            entry = {"tables": tables, "marks": marks, "settled": settled or held["settled"]}
            if entry == held or self.add((numbers[-1] if numbers else 0) + 1, entry):
                return

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.path}/{name}")

    def holds(self, name: str) -> bool:
        return name in self.latest()["tables"] or self.table(name).exists()

    def read(self, name: str) -> DataFrame:
        """A table as of the group's last entry; one that the group doesn't have, as it is."""
        return self.table(name).read(self.latest()["tables"].get(name))
