"""Tables derived from input tables, built once per version of their inputs.

A version is named by the builder's own number and by path, size and time of every input file.  A build writes to
a folder of its own; one small manifest file, moved into place at the end, makes it visible.  So a crashed build is
never seen, two builds at once both stand (the later manifest wins), and a changed input gives another version.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_root
from .tables import table

FOLDER = "store"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _files(spark, path), _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """Written beside its place and moved there, so that readers see all of it or nothing."""
    fs, draft = _files(spark, path), f"{path}.{uuid.uuid4().hex}"
    stream = fs.create(_path(spark, draft))
    try:
        stream.write(bytearray(body, "utf-8"))
    finally:
        stream.close()
    if not fs.rename(_path(spark, draft), _path(spark, path)):
        # another build was first; its table is as good
        fs.delete(_path(spark, draft), False)


def newest_text(spark: SparkSession, folder: str) -> str | None:
    """The published text with the greatest name in a folder, None without one."""
    fs, p = _files(spark, folder), _path(spark, folder)
    names = [str(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
    done = sorted(n for n in names if n.endswith(".json"))
    return read_text(spark, f"{folder}/{done[-1]}") if done else None


def fingerprint(spark: SparkSession, d: str, inputs: list[str], revision: int) -> str:
    """Hash over the files of the input tables: their paths, sizes and times, in any order."""
    held = [f"revision {revision}"]
    for name in sorted(inputs):
        files = table(spark, d, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")).alias("h")).first()
        held.append(f"{name} {row['n']} {row['h']}")
    return hashlib.sha256("\n".join(held).encode()).hexdigest()[:32]


def manifest_path(spark: SparkSession, name: str, version: str) -> str:
    return f"{scratch_root(spark)}/{FOLDER}/{name}/{version}.json"


def stored(spark: SparkSession, d: str, name: str, inputs: list[str], build: Callable[[], DataFrame], revision: int = 1,
           split_by: str | None = None) -> DataFrame:
    """The table ``name`` for the present version of ``inputs``: read if published, else built and published.

    Raise ``revision`` when ``build`` changes its result.  ``split_by`` names a column whose values get folders of their
    own in the one write: rows kept and rows left out, say; a filter on it reads only its folder.
    """
    manifest = manifest_path(spark, name, fingerprint(spark, d, inputs, revision))
    body = read_text(spark, manifest)
    if body is None:
        df = build()
        data = f"{manifest.rsplit('/', 1)[0]}/data-{uuid.uuid4().hex}"
        # these tables stay: texts and hexadecimal hashes take about half the disk that they take under Snappy
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(split_by) if split_by else writer).parquet(data)
        write_text(spark, manifest, json.dumps({"data": data, "schema": df.schema.json(), "built": time.time(), "inputs": inputs}))
        body = read_text(spark, manifest)
    known = json.loads(body)
    return spark.read.schema(_schema(known["schema"])).parquet(known["data"])


def _schema(body: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(body))


def retain(spark: SparkSession, name: str, keep: int = 2, least_age: float = 86_400.0) -> list[str]:
    """Deletes versions of ``name`` beyond the newest ``keep`` that are older than ``least_age`` seconds.

    Their manifests go first, so no reader finds a table that is being deleted.  Data folders that no manifest
    names, left by crashed builds, go by the same age.  Returns the deleted folders.
    """
    root = f"{scratch_root(spark)}/{FOLDER}/{name}"
    fs, now = _files(spark, root), time.time()
    if not fs.exists(_path(spark, root)):
        return []
    entries = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(_path(spark, root))]
    known = {e: json.loads(read_text(spark, f"{root}/{e}") or "{}") for e, _ in entries if e.endswith(".json")}
    newest = sorted(known, key=lambda e: -known[e].get("built", 0))
    gone = [e for e in newest[keep:] if now - known[e].get("built", 0) > least_age]
    for e in gone:
        fs.delete(_path(spark, f"{root}/{e}"), False)
    named = {known[e]["data"].rsplit("/", 1)[1] for e in known if e not in gone}
    dropped = [e for e, at in entries if e.startswith("data-") and e not in named and now - at > least_age]
    for e in dropped:
        fs.delete(_path(spark, f"{root}/{e}"), True)
    return sorted(dropped)
