"""Object storage as a Spark sink: content-addressed objects whose writes become visible together or not at all.

    df.write.format("objects").mode("append").option("path", uri).save()     # df: object_key, payload, content_type

A task puts each payload under its SHA-256 (the same bytes are put once) and lists its keys in a part file. Only the commit
writes a manifest that names the part files, so what an aborted or lost write put is never seen; vacuum() removes it.
Deleting keys or prefixes is a manifest of its own. Paths are URIs that pyarrow.fs knows, shared by driver and executors.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_ENTRY = "object_key string, sha256 string, size long, content_type string"
_DELETION = "object_key string, prefix boolean"


class StorageError(RuntimeError):
    """A key that cannot be stored, or an object that is not there."""


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """(file system, path in it) of a URI or an absolute path."""
    system, path = arrow_fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def checked(key: str | None) -> str:
    """A relative key without empty, . or .. parts."""
    if not key or any(p in ("", ".", "..") for p in key.split("/")):
        raise StorageError(f"not an object key: {key!r}")
    return key


def _blob(root: str, digest: str) -> str:
    return f"{root}/blobs/{digest[:2]}/{digest}"


def _put(system: arrow_fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file whole: under another name first, then moved."""
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    passing = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(passing) as out:
        out.write(data)
    system.move(passing, path)


def _exists(system: arrow_fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type == arrow_fs.FileType.File


def _publish(uri: str, manifest: dict) -> str:
    """Write a manifest; its name orders it after all earlier ones."""
    system, root = opened(uri)
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    _put(system, f"{root}/manifests/{name}.json", json.dumps(manifest, sort_keys=True).encode())
    return name


@dataclass
class Part(WriterCommitMessage):
    """The part file of a task and its entries."""

    path: str
    entries: int


class ObjectSink(DataSource):
    """spark.dataSource.register(ObjectSink); then format("objects") with the option path."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "object_key string, payload binary, content_type string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if "path" not in self.options:
            raise StorageError("the option path is not set")
        return ObjectWriter(self.options["path"], overwrite)


class ObjectWriter(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.run = uri, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Part:
        system, root = opened(self.uri)
        lines = []
        for row in iterator:
            key, data = checked(row["object_key"]), bytes(row["payload"] or b"")
            digest = hashlib.sha256(data).hexdigest()
            if not _exists(system, _blob(root, digest)):
                _put(system, _blob(root, digest), data)
            lines.append(json.dumps({"object_key": key, "sha256": digest, "size": len(data), "content_type": row["content_type"] or "application/octet-stream"}))
        path = f"{root}/parts/{self.run}/{uuid.uuid4().hex}.jsonl"
        if lines:
            _put(system, path, ("\n".join(lines) + "\n").encode())
        return Part(path, len(lines))

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted(m.path for m in messages if m is not None and m.entries)
        _, root = opened(self.uri)
        _publish(self.uri, {"parts": [p.removeprefix(root + "/") for p in parts], "overwrite": self.overwrite})

    def abort(self, messages: list[Part | None]) -> None:
        system, root = opened(self.uri)
        if system.get_file_info(f"{root}/parts/{self.run}").type == arrow_fs.FileType.Directory:
            system.delete_dir(f"{root}/parts/{self.run}")


def delete_objects(uri: str, keys: list[str]) -> None:
    """From now on the keys are not there; keys that were not are no error."""
    _publish(uri, {"deleted": [checked(k) for k in keys]})


def delete_prefix(uri: str, prefix: str) -> None:
    """From now on no key that is the prefix or lies below it is there."""
    _publish(uri, {"deleted_prefix": checked(prefix.strip("/"))})


def _manifests(uri: str) -> list[tuple[str, dict]]:
    """(name, manifest) in order; one a write, not one an object."""
    system, root = opened(uri)
    found = system.get_file_info(arrow_fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    out = []
    for info in sorted((f for f in found if f.path.endswith(".json")), key=lambda f: f.path):
        with system.open_input_stream(info.path) as f:
            out.append((info.base_name.removesuffix(".json"), json.loads(f.read())))
    return out


def objects(spark: SparkSession, uri: str) -> DataFrame:
    """(object_key, sha256, size, content_type) of all visible objects: each key's last committed write that nothing later deleted.

    Of a key that one write holds twice the larger digest is taken.
    """
    _, root = opened(uri)
    scheme = uri[: uri.index(root)] if root in uri else ""
    told = _manifests(uri)
    since = max((i for i, (_, m) in enumerate(told) if m.get("overwrite")), default=0)
    puts = [(n, p) for n, m in told[since:] for p in m.get("parts", [])]
    if not puts:
        return spark.createDataFrame([], _ENTRY)
    version = spark.createDataFrame([(p.rsplit("/", 1)[-1], n) for n, p in puts], "part string, version string")  # one row a part file
    rows = spark.read.schema(_ENTRY).json([f"{scheme}{root}/{p}" for _, p in puts]).withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -1)).join(F.broadcast(version), "part").drop("part")
    last = rows.withColumn("place", F.row_number().over(Window.partitionBy("object_key").orderBy(F.desc("version"), F.desc("sha256")))).where("place = 1").drop("place")
    gone = [(n, k, False) for n, m in told[since:] for k in m.get("deleted", [])] + [(n, m["deleted_prefix"], True) for n, m in told[since:] if "deleted_prefix" in m]
    if gone:
        d = spark.createDataFrame(gone, "deleted_at string, gone string, prefix boolean")
        ups = F.transform(F.sequence(F.lit(1), F.size(F.split("object_key", "/"))), lambda i: F.array_join(F.slice(F.split("object_key", "/"), F.lit(1), i), "/"))
        exact = d.where("not prefix").groupBy(F.col("gone").alias("object_key")).agg(F.max("deleted_at").alias("at_key"))
        below = d.where("prefix").groupBy("gone").agg(F.max("deleted_at").alias("at_prefix"))
        over = last.select("object_key", F.explode(ups).alias("gone")).join(below, "gone").groupBy("object_key").agg(F.max("at_prefix").alias("at_prefix"))
        last = last.join(exact, "object_key", "left").join(over, "object_key", "left").where("version > greatest(coalesce(at_key, ''), coalesce(at_prefix, ''))").drop("at_key", "at_prefix")
    return last.drop("version")


def payloads(entries: DataFrame, uri: str) -> DataFrame:
    """entries (object_key, sha256, content_type) with their payload, read where the rows are and checked against its digest."""

    def run(batches):
        system, root = opened(uri)
        for batch in batches:
            for i in range(batch.num_rows):  # one object a batch: payloads may be large
                row = batch.slice(i, 1)
                digest = row.column(1)[0].as_py()
                with system.open_input_stream(_blob(root, digest)) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise StorageError(f"object {row.column(0)[0].as_py()!r} is damaged")
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], [*row.schema.names, "payload"])

    return entries.select("object_key", "sha256", "content_type").mapInArrow(run, "object_key string, sha256 string, content_type string, payload binary")


def vacuum(spark: SparkSession, uri: str, older_seconds: float = 86_400) -> int:
    """Delete payloads that no visible object has, and that are older than so many seconds; their number. Deleted keys then
    cannot come back; a write that is going on is younger than that. The empty payload (one file of no bytes) stays."""
    system, root = opened(uri)
    if system.get_file_info(f"{root}/blobs").type != arrow_fs.FileType.Directory:
        return 0
    scheme = uri[: uri.index(root)] if root in uri else ""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{scheme}{root}/blobs").select(F.element_at(F.split("path", "/"), -1).alias("sha256"), "modificationTime")
    old = held.where(F.unix_micros("modificationTime") <= F.lit(int((time.time() - older_seconds) * 1e6)))

    def run(batches):
        system, root = opened(uri)
        for batch in batches:
            for digest in batch.column(0).to_pylist():
                system.delete_file(_blob(root, digest))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return old.join(objects(spark, uri).select("sha256").distinct(), "sha256", "left_anti").select("sha256").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
