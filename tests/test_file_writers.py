"""Small files are written by all cores, however few partitions their rows have."""

from pyspark.sql import functions as F

from viewloom.catalog import files as catalog
from viewloom.catalog import logs
from viewloom.sources import files, live


def tagged(path):
    """The file system of a path, with the task's number in the path."""
    from pyarrow import fs
    from pyspark import TaskContext

    return fs.LocalFileSystem(), path.replace("/all", f"/task{TaskContext.get().partitionId()}")


def by_value():
    import types

    return types.FunctionType(tagged.__code__, {"__builtins__": __builtins__}, "by_value")


def test_files_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "opened", by_value())
    rows = spark.range(40).coalesce(1).select(F.format_string("u%d/n.txt", "id").alias("path"), F.lit("x").alias("text"))
    catalog._write_files(rows, f"{tmp_path}/all")
    assert len(list(tmp_path.glob("task*/*/n.txt"))) == 40 and len(list(tmp_path.glob("task*"))) > 4


def test_logs_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(r, n, f"{r} {n}") for r in (None, *map(str, range(40))) for n in (2, 1)]
    lines = spark.createDataFrame(rows, "run STRING, line_no BIGINT, value STRING").coalesce(1)
    logs._write_logs(lines, f"{tmp_path}/logs")
    read = files.read_logs(spark, f"{tmp_path}/logs", "part-*.txt").orderBy("run", "line_no").collect()
    assert [r.line for r in read if r.run == "run=7"] == ["7 1", "7 2"] and len(read) == 82
    assert sum(r.run == f"run={logs.NO_RUN}" for r in read) == 2
    assert [r.line for r in files.read_logs(spark, f"{tmp_path}/logs", "part-*.gz").collect()] == ["step 7"] * 41
    monkeypatch.setattr(live, "opened", by_value())
    logs._write_logs(lines, f"{tmp_path}/all")
    assert len(list(tmp_path.glob("task*"))) > 8
