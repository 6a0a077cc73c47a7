"""Snapshots of several tables that are seen as a whole or not at all.

A commit writes its tables to a new folder and then puts one small manifest in place, named by the version's number, by a
rename that fails where that version is there already. Readers take all tables from the newest manifest, so they see those
of one commit; a commit that was broken off left no manifest, and is as if it had never begun. Of two writers that start
from one version the later one loses, and its folder goes. All of it goes through the file system that Spark opens.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed since."""


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The file appears with all of its text, and only where there is none of its name."""
        draft = f"_draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.at(name).getParent())
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.jvm.py4j.reflection.ReflectionUtil.classForName("org.apache.hadoop.fs.Options$Rename")
        only = self.jvm.java.lang.reflect.Array.newInstance(how, 1)
        self.jvm.java.lang.reflect.Array.set(only, 0, rename.NONE)
        try:
            full = self.fs.makeQualified(self.at(draft)).toUri()
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(full, self.conf).rename(self.fs.makeQualified(self.at(draft)), self.fs.makeQualified(self.at(name)), only)
        except Py4JJavaError as e:
            self.drop(draft)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{name} is there already") from None
            raise

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _manifest(version: int) -> str:
    return f"_manifests/{version:010d}.json"


def version_of(spark: SparkSession, folder: str) -> int:
    """The newest version, 0 where there is none."""
    return max((int(n.removesuffix(".json")) for n in _Folder(spark, folder).names("_manifests") if n.endswith(".json")), default=0)


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """What a version (the newest one) holds: tables by name, with path, schema and rows, and its provenance."""
    version = version or version_of(spark, folder)
    if not version:
        raise FileNotFoundError(f"{folder} has no complete snapshot")
    return json.loads(_Folder(spark, folder).text(_manifest(version)))


def read(spark: SparkSession, folder: str, names: tuple[str, ...] = (), version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version by name: all of them, or those asked for; one that isn't there is an error."""
    held = manifest(spark, folder, version)["tables"]
    if missing := sorted(set(names) - set(held)):
        raise FileNotFoundError(f"the snapshot in {folder} has no {', '.join(missing)}")
    return {n: spark.read.schema(StructType.fromJson(held[n]["schema"])).parquet(f"{folder.rstrip('/')}/{held[n]['path']}") for n in names or held}


def commit(tables: dict[str, DataFrame], folder: str, base: int | None = None, provenance: dict[str, str] | None = None) -> int:
    """Writes the tables as the version after base (after the newest one), and returns its number. If anything fails, the
    versions before stay as they are."""
    spark = next(iter(tables.values())).sparkSession
    files = _Folder(spark, folder)
    version = (version_of(spark, folder) if base is None else base) + 1
    part = f"data-{uuid.uuid4().hex}"
    try:
        held = {}
        for name, df in tables.items():
            df.write.parquet(f"{files.path}/{part}/{name}")
            held[name] = {"path": f"{part}/{name}", "schema": df.schema.jsonValue(), "rows": spark.read.schema(df.schema).parquet(f"{files.path}/{part}/{name}").count()}
        files.put(_manifest(version), json.dumps({"version": version, "tables": held, "provenance": provenance or {}}))
    except BaseException:
        files.drop(part)
        raise
    return version


def write_once(tables: dict[str, DataFrame], folder: str, provenance: dict[str, str] | None = None) -> int:
    """Commits only where there is no complete snapshot yet; what a run that was broken off has left is no snapshot."""
    try:
        return version_of(next(iter(tables.values())).sparkSession, folder) or commit(tables, folder, 0, provenance)
    except Conflict:  # another run was faster
        return version_of(next(iter(tables.values())).sparkSession, folder)
