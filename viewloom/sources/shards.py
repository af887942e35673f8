"""Sample shards: Parquet files in one directory, chosen by name."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.functions.text import plain_path

KEY = "__key__"


def _plain(path: str) -> str:
    return re.sub(r"^\w+:/*|^/*", "/", path).rstrip("/")


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether the path names one file; only its listing is read."""
    try:
        listed = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()
    except AnalysisException:
        return False
    return len(listed) == 1 and _plain(listed[0].path) == _plain(path)


def read_shards(
    spark: SparkSession, path: str, prefix: str | None = None, exact: bool = False, merge_schema: bool = False
) -> DataFrame:
    """The shards of ``path``: a file is itself, a directory gives its direct children.

    A child is a file, or a directory ``*.parquet`` of part files as Spark writes it.
    ``prefix`` keeps ``{prefix}*.parquet`` and a file called exactly ``prefix``.
    A prefix may also match a longer data-set name; ``exact`` keeps only
    ``prefix`` followed by a shard number.
    """
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    if _is_file(spark, path):
        return reader.parquet(path)
    names = [f"{prefix or ''}*.parquet"]
    if prefix is not None and _is_file(spark, f"{path.rstrip('/')}/{prefix}"):
        names.append(prefix)
    try:
        shards = reader.parquet(f"{path.rstrip('/')}/{{{','.join(names)}}}")
    except AnalysisException:
        # no such child: the files may lie in partition folders
        try:
            shards = reader.option("pathGlobFilter", f"{{{prefix or ''}*.parquet,{prefix or ''}}}").parquet(path)
        except AnalysisException as problem:
            raise FileNotFoundError(f"no Parquet shards in {path} for prefix {prefix}") from problem
    if prefix is not None and exact:
        number = r"([-_.]\d{3,}(-of-\d+)?)?"
        folder = _plain(path).rsplit("/", 1)[-1]
        shards = shards.where(
            plain_path(F.col("_metadata.file_name")).rlike(rf"^\Q{prefix}\E{number}(\.parquet)?$")
            | plain_path(F.col("_metadata.file_path")).rlike(rf"/\Q{folder}\E/+\Q{prefix}\E{number}\.parquet/")
        )
    return shards


def read_captions(spark: SparkSession, path: str, uid_col: str = "uid", caption_col: str = "caption", **kwargs) -> DataFrame:
    """Only the two text columns of the shards; the image columns are never read."""
    return read_shards(spark, path, **kwargs).select(
        F.col(uid_col).cast("string").alias("uid"), F.col(caption_col).cast("string").alias("caption")
    )


def with_row_key(shards: DataFrame) -> DataFrame:
    """``__key__`` as stored, else ``file:row`` (the row counted in its file); part files are named with their shard."""
    name = F.regexp_extract(plain_path(F.col("_metadata.file_path")), r"([^/]*\.parquet/)?[^/]*$", 0)
    made = F.concat_ws(":", name, F.col("_metadata.row_index").cast("string"))
    key = F.coalesce(F.col(KEY).cast("string"), made) if KEY in shards.columns else made
    return shards.withColumn(KEY, key)


def count_rows(shards: DataFrame) -> int:
    """Rows of the shards; Parquet answers from the file footers."""
    return shards.count()


def decode_legacy(shards: DataFrame) -> DataFrame:
    """Text columns of shards that stored every string as UTF-8 bytes."""
    text = [f.name for f in shards.schema.fields if f.name in ("uid", "caption") and f.dataType.simpleString() == "binary"]
    return shards.withColumns({name: F.decode(F.col(name), "UTF-8") for name in text}) if text else shards
