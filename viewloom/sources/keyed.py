"""Keyed tables in few files, whose readers never see half a write.

A write becomes a segment: a folder of its own with the rows of some keys. A manifest names the segments that make up
the table; it is created in one step, so a reader sees a write whole or not at all. Of the rows of a key those of its
latest segment count. Small segments are merged into larger ones as they come: their number grows with the logarithm
of the rows, each row is rewritten so many times at most, and the number of files follows the rows, not the keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Rows of a file, and manifests whose segments stay for readers that opened them.
FILE_ROWS, KEPT = 1 << 20, 3
VERSION = "_version"


class _Folder:
    """The files of a table, wherever Spark can reach them."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.root = path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file with that text, complete when it can be seen; False if there is one of that name."""
        draft = self._path(f"_drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self._path(name).getParent())
        if self.fs.exists(self._path(name)) or not self.fs.rename(draft, self._path(name)):
            self.fs.delete(draft, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _manifests(folder: _Folder) -> list[str]:
    return [n for n in folder.names("_manifests") if n.endswith(".json")]


def _latest(folder: _Folder) -> dict:
    found = _manifests(folder)
    if not found:
        return {"number": 0, "schema": None, "keys": [], "segments": [], "batches": {}}
    return json.loads(folder.text(f"_manifests/{found[-1]}"))


def _winners(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the latest version of each key: one partial aggregation, and a join that may split hot keys."""
    key = F.struct(*keys)  # a struct: equal even where a column is null
    keyed = rows.withColumn("_key", key)
    last = keyed.groupBy("_key").agg(F.max(VERSION).alias("_last"))
    kept = keyed.join(last, "_key").where(F.col(VERSION) == F.col("_last"))
    return kept.drop("_key", "_last")


def _read(spark: SparkSession, folder: _Folder, manifest: dict, segments: list[dict]) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"]).add(VERSION, LongType())
    return spark.read.schema(schema).parquet(*(f"{folder.root}/{s['name']}" for s in segments))


def _segment(rows: DataFrame, folder: _Folder) -> dict:
    """``rows`` as a new segment in files of about ``FILE_ROWS``; nobody reads it before a manifest names it."""
    spark, name = rows.sparkSession, f"segment-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder.root}/{name}")
    stored = spark.read.schema(rows.schema).parquet(f"{folder.root}/{name}")
    count = stored.count()
    files = len([n for n in folder.names(name) if n.endswith(".parquet")])
    most = -(-count // FILE_ROWS)
    if files > max(1, 2 * most):
        rewritten = f"segment-{uuid.uuid4().hex}"
        stored.coalesce(max(1, most)).write.parquet(f"{folder.root}/{rewritten}")
        folder.delete(name)
        name = rewritten
    return {"name": name, "rows": count}


def merge(rows: DataFrame, path: str, keys: Sequence[str], source: str | None = None, batch: int | None = None) -> int:
    """Writes ``rows``: for each of their keys they replace what the table had. Returns the table's new number.

    ``source`` and ``batch`` name a write that may be repeated: a batch of a source that is no later than the last one
    written changes nothing. Several rows of one key in one write all stay. A write without rows changes no row.
    """
    spark, folder = rows.sparkSession, _Folder(rows.sparkSession, path)
    segment = None
    while True:
        manifest = _latest(folder)
        if source is not None and batch is not None and batch <= manifest["batches"].get(source, -1):
            if segment:
                folder.delete(segment["name"])
            return manifest["number"]
        if manifest["schema"] is None:
            manifest |= {"schema": rows.schema.jsonValue(), "keys": list(keys)}
        elif manifest["keys"] != list(keys):
            raise ValueError(f"the table's keys are {manifest['keys']}")
        number = manifest["number"] + 1
        if segment is None:
            kinds = StructType.fromJson(manifest["schema"])
            named = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds))
            segment = _segment(named.withColumn(VERSION, F.lit(number).cast("long")), folder) | {"version": number}
        elif segment["version"] != number:
            # somebody else was faster: the rows get their place behind theirs
            own = _read(spark, folder, manifest, [segment]).withColumn(VERSION, F.lit(number).cast("long"))
            segment = _segment(own, folder) | {"version": number}
        segments = [*manifest["segments"], segment] if segment["rows"] else manifest["segments"]
        segments = _merged(spark, folder, manifest, segments)
        batches = manifest["batches"] | ({source: batch} if source is not None else {})
        text = json.dumps(manifest | {"number": number, "segments": segments, "batches": batches})
        if folder.create(f"_manifests/{number:012d}.json", text):
            _forget(folder)
            return number


def _merged(spark: SparkSession, folder: _Folder, manifest: dict, segments: list[dict]) -> list[dict]:
    """Segments of which each has more than twice the rows of the next one."""
    take = len(segments) - 1
    total = segments[-1]["rows"] if segments else 0
    while take > 0 and segments[take - 1]["rows"] <= 2 * total:
        take -= 1
        total += segments[take]["rows"]
    if take >= len(segments) - 1:
        return segments
    last = segments[take:]
    rows = _winners(_read(spark, folder, manifest, last), manifest["keys"])
    return [*segments[:take], _segment(rows, folder) | {"version": last[-1]["version"]}]


def _forget(folder: _Folder) -> None:
    """Deletes manifests but for the latest, and the segments that none of these names."""
    found = _manifests(folder)
    named = {s["name"] for n in found[-KEPT:] for s in json.loads(folder.text(f"_manifests/{n}"))["segments"]}
    gone = {s["name"] for n in found[:-KEPT] for s in json.loads(folder.text(f"_manifests/{n}"))["segments"]} - named
    for name in gone:
        folder.delete(name)
    for n in found[:-KEPT]:
        folder.delete(f"_manifests/{n}")


def read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The table as of now: the rows of each key's latest write. ``schema`` is for a table nobody wrote to yet."""
    folder = _Folder(spark, path)
    manifest = _latest(folder)
    if not manifest["segments"]:
        known = StructType.fromJson(manifest["schema"]) if manifest["schema"] else schema
        if known is None:
            raise ValueError(f"there is no table at {path}")
        return spark.createDataFrame([], known)
    rows = _read(spark, folder, manifest, manifest["segments"])
    if len(manifest["segments"]) > 1:
        rows = _winners(rows, manifest["keys"])
    return rows.drop(VERSION)
