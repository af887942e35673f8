"""Small helpers shared by the text operators."""

from __future__ import annotations

import string
import sys
import types
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from viewloom.session import scratch_path


def fresh(df: DataFrame, *names: str, also: Iterable[str] = ()) -> list[str]:
    """Column names that do not clash with those of ``df``, or ``also`` others, whatever their case."""
    taken, out = {c.lower() for c in (*df.columns, *also)}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, as ``doc_id`` and ``text``; a null text is empty."""
    return docs.select(
        quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text")
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch table and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def values_sql(rows: Iterable[tuple], columns: str) -> str:
    """A small constant table in SQL that Spark and DuckDB both read."""

    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS constants({columns})"


def constants(spark: SparkSession, rows: Iterable[tuple], columns: str) -> DataFrame:
    return spark.sql(values_sql(rows, columns))


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row ``df[times]`` times, with no array longer than the root of it; drops that column."""
    side = F.ceil(F.sqrt(F.col(times).cast("double"))).cast("int")
    keep = [c for c in df.columns if c != times]
    out = df.withColumn("__r", F.explode(F.sequence(F.lit(0), side - 1)))
    left = F.least(side, F.col(times).cast("int") - F.col("__r") * side)
    out = out.withColumn("__left", left).where("__left > 0")
    return out.withColumn("__r", F.explode(F.sequence(F.lit(1), F.col("__left")))).select(*keep)


def add_columns(df: DataFrame, fields: str, make, keep: list[str] | None = None, cache: tuple | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with further columns that Python computes from its Arrow batches.

    ``make()`` is called once in each task and gives a function from a batch to the new arrays, in the order of
    ``fields`` (DDL). A batch holds at most ``spark.sql.execution.arrow.maxBytesPerBatch`` bytes. ``cache`` is the key
    under which ``make`` uses ``worker_cache``, if it does; what earlier tasks kept under others is freed.
    """
    names = df.columns
    kept = names if keep is None else keep
    new_fields = StructType.fromDDL(fields).fields
    # plain names on the way: columns of the caller's may have dots in theirs
    plain = df.toDF(*(f"c{k}" for k in range(len(names))))
    places = [names.index(c) for c in kept]
    schema = StructType(
        [StructField(f"c{k}", df.schema[p].dataType) for k, p in enumerate(places)]
        + [StructField(f"n{k}", f.dataType) for k, f in enumerate(new_fields)]
    )

    def run(batches):
        free_worker(cache)
        new = make()
        for batch in batches:
            batch = batch.rename_columns(names)
            arrays = [*(batch.column(p) for p in places), *new(batch)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*kept, *(f.name for f in new_fields))


def _kept_by_worker() -> dict[tuple, object]:
    # functions travel by value, so their modules' own variables do not outlive a task
    holder = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    return vars(holder).setdefault("kept", {})


def free_worker(but: tuple | None = None) -> None:
    """Drops what earlier tasks left in ``worker_cache``, save under the key ``but``: workers outlive their stage, and
    the next ones need the memory."""
    kept = _kept_by_worker()
    for key in [k for k in kept if k != but]:
        del kept[key]


def worker_cache(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gave in an earlier task of this Python worker, or gives now: for what is costly to build."""
    kept = _kept_by_worker()
    if key not in kept:
        kept[key] = make()
    return kept[key]


def texts_of(batch: pa.RecordBatch, name: str, rows: int = 256) -> Iterable[list]:
    """The strings of a column, some rows at a time, so that Python does not hold those of a whole batch."""
    column = batch.column(name)
    for k in range(0, len(column), rows):
        yield column.slice(k, rows).to_pylist()


def pieces_of(texts: list, most: int) -> Iterable[list]:
    """Consecutive slices of a list of strings with about ``most`` characters each; at least one string."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > most:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own
