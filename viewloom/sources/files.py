"""Files around the samples: renders, captions, id lists, prompts, logs, artifacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewloom.functions.text import plain_path, strip
from viewloom.operators.rows import explode_rows

# Image suffixes, compared case-sensitively.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp")


def read_renders(spark: SparkSession, path: str) -> DataFrame:
    """(uid, view_id, kind, path, mtime, length, content) of ``{object}/{NNNNN}.{png,json}``.

    Another file of an object gives a row without view, so that an object without
    any view is still seen; files directly in ``path`` belong to no object.
    ``content`` is only loaded if it is selected.
    """
    root = path.rstrip("/").replace("file:", "", 1).rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    view = r"/(\d{5})\.(png|json)$"
    found = files.select(
        F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("uid"),
        F.regexp_extract("path", view, 1).try_cast("int").alias("view_id"),
        F.nullif(F.regexp_extract("path", view, 2), F.lit("")).alias("kind"),
        "path",
        F.col("modificationTime").alias("mtime"),
        "length",
        "content",
    )
    return found.where(F.col("view_id").isNotNull() | (F.col("uid") != root))


def render_views(renders: DataFrame) -> DataFrame:
    """(uid, view_id, png, camera_json) with NULL for the missing half."""
    return renders.where(F.col("view_id").isNotNull()).groupBy("uid", "view_id").agg(
        F.max(F.when(F.col("kind") == "png", F.col("content"))).alias("png"),
        F.max(F.when(F.col("kind") == "json", F.col("content"))).alias("camera_json"),
    )


def render_flags(renders: DataFrame) -> DataFrame:
    """(uid, view_id, has_png, has_json) from names alone."""
    return renders.select(
        "uid", "view_id", (F.col("kind") == "png").alias("has_png"), (F.col("kind") == "json").alias("has_json")
    )


def _file_order() -> Column:
    """Rows in file order: by file, then by split, then as read inside the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"),
    )


def read_caption_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(oid, caption) of a CSV without header; a later line for an oid wins.

    Captions with line breaks need ``multi_line``, which reads a file in one
    task; a file without them may be split.
    """
    lines = (
        spark.read.schema("oid STRING, caption STRING")
        .option("header", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
        .withColumn("_at", _file_order())
    )
    return lines.groupBy("oid").agg(F.max_by("caption", "_at").alias("caption"))


def read_json_map(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """(gid, path) of one JSON object per file, or per line (such a file may be split)."""
    whole = spark.read.text(path, wholetext=not per_line)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("gid", "path"))


def read_json_list(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """(pos, gid) of one JSON array per file, or per line."""
    whole = spark.read.text(path, wholetext=not per_line)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "gid"))


def split_prompts(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """Lines of a text column: stripped, blank ones dropped, in order."""
    lines = explode_rows(texts, F.split(F.col(text), "\r\n|\r|\n"), "_line", keep, "line_no")
    return lines.select(*keep, "line_no", strip(F.col("_line")).alias("prompt")).where(F.col("prompt") != "")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(suite, line_no, prompt); the suite is the file name without suffix."""
    whole = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(plain_path(F.col("_metadata.file_name")), r"\.[^.]*$", "").alias("suite"), "value"
    )
    return split_prompts(whole, "value", "suite")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files directly in a directory, sorted by path; contents are not read. Spark passes over empty files."""
    glob = "*.{" + ",".join(IMAGE_SUFFIXES) + "}"
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", F.col("modificationTime").alias("mtime"), "length")
        .orderBy("path")
    )


def read_logs(
    spark: SparkSession, path: str, name: str = "log.txt", keep: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(run, file, line_no, line) of ``{run}/log.txt``, or of another log of every run, such as ``log_infer.txt``.

    The log operators take one log of each run; ``name`` may be a pattern if it
    matches one file of a run.  White space at the end of a line is dropped.

    ``line_no`` grows along the file but has gaps: it is the byte offset of the
    split plus the line's number in the split, so a huge log is read by many
    tasks.  Lines end at ``\\n`` only; a progress bar redraws itself with ``\\r``
    inside one line.  ``keep`` is a test of a line; lines that fail it are
    dropped before the rest is numbered, which keeps them out of the shuffle.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .option("lineSep", "\n")
        .text(path)
        .select(
            F.regexp_extract(plain_path(F.col("_metadata.file_path")), r"/([^/]+)/[^/]+$", 1).alias("run"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_id"),
            F.regexp_replace("value", r"(?U)\s+$", "").alias("line"),
        )
    )
    if keep is not None:
        lines = lines.where(keep(F.col("line")))
    inside = W.partitionBy("file", "_start").orderBy("_id")
    return lines.withColumn("line_no", F.col("_start") + F.row_number().over(inside) - 1).select(
        "run", "file", "line_no", "line"
    )


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(run, path, name, mtime, length) of every file below ``{path}/{run}``."""
    root = path.rstrip("/").replace("file:", "", 1).lstrip("/")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.regexp_extract("path", rf"\Q{root}\E/([^/]+)/", 1).alias("run"),
            "path",
            F.substring_index("path", "/", -1).alias("name"),
            F.col("modificationTime").alias("mtime"),
            "length",
        )
        .where(F.col("run") != "")
    )
