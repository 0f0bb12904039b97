"""Tables that several writers publish into: an optimistic log of numbered commits.

A writer stages the new rows of all its tables in folders of its own, judged
against the last commit it knows, and then claims the next number.  The claim is a
file that only one writer can create.  Who comes second looks at what was
committed in between: rows of one key must be equal, equal ones are staged anew
without their doubles, and the claim is tried for the number behind.  Readers see
the rows of numbered commits and nothing else, so a lost writer leaves nothing.

The file system must have a rename, or locally a link, that fails where the target
is; HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 20


class Refused(ValueError):
    """A stored key was to get other content."""


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def compared(rows: DataFrame, stored: DataFrame, key: str | list[str]) -> DataFrame:
    """Adds outcome to rows of one key each: insert, same (stored as it is) or refused (stored with other content)."""
    keys = _keys(key)
    content = [c for c in rows.columns if c not in keys]
    had = stored.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.struct(F.lit(True).alias("_there"), *content).alias("_had"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    for condition in same[1:]:
        same[0] = same[0] & condition
    own = F.struct(F.lit(True).alias("_there"), *content)
    joined = rows.join(had, same[0], "left")
    return joined.withColumn("outcome", F.when(F.col("_had").isNull(), "insert").when(F.col("_had").eqNullSafe(own), "same").otherwise("refused")).drop("_had", *(f"_k{n}" for n in range(len(keys))))


class CommitLog:
    """The commits under a folder: ``_log`` has a file for each, ``name``/publication=... the rows of a table in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._at(self.path).getFileSystem(self.conf)

    def entries(self, version: int | None = None) -> list[dict]:
        """The commits up to a version, in order: version, publication and the names of its tables.  One small file each."""
        files, log = self._files(), self._at(f"{self.path}/_log")
        if not files.exists(log):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(log))
        names = [n for n in names if n[:DIGITS].isdigit() and n.endswith(".json") and (version is None or int(n[:DIGITS]) <= version)]
        if not names:
            return []
        rows = self.spark.read.schema("version bigint, publication string, tables array<string>").json([f"{self.path}/_log/{n}" for n in names]).collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["version"])

    def latest(self) -> int:
        return max((e["version"] for e in self.entries()), default=0)

    def read(self, name: str, schema: T.StructType, version: int | None = None, after: int = 0) -> DataFrame:
        """The rows of a table as of a version, or only those of commits behind ``after``; only the folders of these commits are read."""
        folders = [f"{self.path}/{name}/publication={e['publication']}" for e in self.entries(version) if name in e["tables"] and e["version"] > after]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _claim(self, entry: dict) -> bool:
        """Create the commit's file, whole, if there is none."""
        files = self._files()
        target = self._at(f"{self.path}/_log/{entry['version']:0{DIGITS}}.json")
        draft = self._at(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()
        try:
            if files.getScheme() == "file":
                path = lambda at: self.jvm.java.nio.file.Paths.get(files.makeQualified(at).toUri())
                self.jvm.java.nio.file.Files.createLink(path(target), path(draft))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
                context.rename(draft, target, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            if "FileAlreadyExists" in str(error) or files.exists(target):
                return False
            raise
        finally:
            files.delete(draft, False)
        return True

    def begin(self) -> Writer:
        return Writer(self)

    def publish(self, tables: dict[str, tuple[DataFrame, str | list[str]]]) -> int | None:
        """Stage and commit ``tables`` (name: (rows, key)); the commit's version, null where nothing is new."""
        writer = self.begin()
        writer.stage(tables)
        return writer.commit()


class Writer:
    """One publication, from the commits that it knows (``base``) to its own."""

    def __init__(self, log: CommitLog):
        self.log, self.base = log, log.latest()
        self.staged: dict[str, tuple[T.StructType, str | list[str], str]] = {}

    def _write(self, name: str, rows: DataFrame, key: str | list[str], mark: str) -> None:
        """Stage a table's rows under a mark of their own; nothing is kept of a table without any."""
        at = f"{self.log.path}/{name}/publication={mark}"
        rows.write.mode("error").parquet(at)
        if not self.log.spark.read.schema(rows.schema).parquet(at).isEmpty():
            self.staged[name] = (rows.schema, key, mark)

    def _fresh(self, name: str, rows: DataFrame, key: str | list[str], stored: DataFrame) -> DataFrame:
        judged = compared(rows, stored, key)
        if not judged.filter("outcome = 'refused'").isEmpty():
            raise Refused(f"{name}: a stored id cannot be reused with different content")
        return judged.filter("outcome = 'insert'").drop("outcome")

    def stage(self, tables: dict[str, tuple[DataFrame, str | list[str]]]) -> None:
        """Write the rows that aren't stored yet.  An id may stand once in a publication; a stored one must be equal."""
        mark = uuid.uuid4().hex
        fresh = {}
        for name, (rows, key) in tables.items():
            if not rows.groupBy(*_keys(key)).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
                raise ValueError(f"{name}: an id stands twice in a publication")
            fresh[name] = self._fresh(name, rows, key, self.log.read(name, rows.schema, self.base))
        for name, rows in fresh.items():
            self._write(name, rows, tables[name][1], mark)

    def _rebase(self, latest: int) -> None:
        """Judge the staged rows against what was committed since ``base``."""
        mark = uuid.uuid4().hex
        for name, (schema, key, own) in list(self.staged.items()):
            between = self.log.read(name, schema, latest, after=self.base)
            rows = self.log.spark.read.schema(schema).parquet(f"{self.log.path}/{name}/publication={own}")
            judged = compared(rows, between, key)
            known = {r["outcome"] for r in judged.select("outcome").distinct().collect()}
            if "refused" in known:
                raise Refused(f"{name}: a stored id cannot be reused with different content")
            if "same" in known:
                del self.staged[name]
                self._write(name, judged.filter("outcome = 'insert'").drop("outcome"), key, mark)
        self.base = latest

    def commit(self) -> int | None:
        """Claim the next version, behind whatever was committed meanwhile; null where nothing new is left."""
        while self.staged:
            marks = {mark for _, _, mark in self.staged.values()}
            if len(marks) > 1:  # a rebase wrote some tables anew: all go under one mark
                mark = uuid.uuid4().hex
                for name, (schema, key, own) in list(self.staged.items()):
                    self._write(name, self.log.spark.read.schema(schema).parquet(f"{self.log.path}/{name}/publication={own}"), key, mark)
                marks = {mark}
            entry = {"version": self.base + 1, "publication": marks.pop(), "tables": sorted(self.staged)}
            if self.log._claim(entry):
                return entry["version"]
            self._rebase(self.log.latest())
        return None
