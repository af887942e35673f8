"""Run logs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewloom.catalog import standins as S
from viewloom.catalog.base import query, table
from viewloom.operators import logs
from viewloom.session import scratch_path
from viewloom.sources import files, sinks
from viewloom.sources import live as source
from viewloom.streaming import logs as live

_ASOF_SQL = f"""{S.PARSED_SQL},
everything AS (
  SELECT run, line_no, step, NULL::DOUBLE AS psnr, NULL::DOUBLE AS lpips, NULL::DOUBLE AS ssim FROM train
  UNION ALL SELECT run, line_no, NULL, psnr, lpips, ssim FROM val),
walked AS (
  SELECT run, line_no, coalesce(last_value(step IGNORE NULLS) OVER (PARTITION BY run ORDER BY line_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS step, psnr, lpips, ssim FROM everything),
stepped AS (SELECT * FROM walked WHERE psnr IS NOT NULL)"""

_STATUS_SQL = f"""{S.PARSED_SQL},
status AS (
  SELECT r.run, t.step, t.loss, t.lr, v.psnr, v.lpips, s.ssim
  FROM (SELECT run FROM train UNION SELECT run FROM val) r
  LEFT JOIN (SELECT run, max_by(step, line_no) AS step, max_by(loss, line_no) AS loss, max_by(lr, line_no) AS lr FROM train GROUP BY run) t USING (run)
  LEFT JOIN (SELECT run, max_by(psnr, line_no) AS psnr, max_by(lpips, line_no) AS lpips FROM val GROUP BY run) v USING (run)
  LEFT JOIN (SELECT run, max_by(ssim, line_no) AS ssim FROM val WHERE ssim IS NOT NULL GROUP BY run) s USING (run))"""

_TAIL_SQL = f"""{S.LINES_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY line_no DESC) AS r FROM lines)
SELECT run, line_no, line FROM ranked WHERE r <= """

_PARSED_ROWS_SQL = f"""WITH {S.PARSED_SQL}
SELECT run, line_no, step, loss, lr, NULL::DOUBLE AS psnr, NULL::DOUBLE AS lpips, NULL::DOUBLE AS ssim FROM train
UNION ALL SELECT run, line_no, NULL, NULL, NULL, psnr, lpips, ssim FROM val"""

# Chunks far shorter than a run, so that the as-of join carries steps across them.
CHUNK = 1024


@query(f"WITH {S.PARSED_SQL} SELECT * FROM train")
def parse_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_train(S.lines(spark, sf_dir))


@query(f"WITH {S.PARSED_SQL} SELECT * FROM val")
def parse_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_val(S.lines(spark, sf_dir))


@query(f"WITH {_ASOF_SQL} SELECT * FROM stepped")
def asof_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.asof_step(logs.scan_lines(S.lines(spark, sf_dir)), chunk=CHUNK)


@query(f"WITH {_TAIL_SQL} 20")
def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.tail_lines(S.lines(spark, sf_dir), 20)


@query(f"WITH {_STATUS_SQL} SELECT * FROM status")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.run_status(logs.scan_lines(S.lines(spark, sf_dir)))


@query(
    f"""WITH {_ASOF_SQL}
SELECT run, step, 'training/loss' AS name, loss AS value FROM train UNION ALL SELECT run, step, 'training/lr', lr FROM train
UNION ALL SELECT run, step, 'validation/psnr', psnr FROM stepped UNION ALL SELECT run, step, 'validation/lpips', lpips FROM stepped
UNION ALL SELECT run, step, 'validation/ssim', ssim FROM stepped WHERE ssim IS NOT NULL"""
)
def metric_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines to the metric table and back."""
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(logs.metric_rows(logs.scan_lines(S.lines(spark, sf_dir))), path)
    return sinks.read_metrics(spark, path)


BATCHES = 4


#: Tasks for each core that write logs, two files for each run.
LOG_TASKS = 4
NO_RUN = "__HIVE_DEFAULT_PARTITION__"


def _write_logs(lines: DataFrame, path: str) -> None:
    """Writes two text logs of each run: its lines in order, and a compressed one of one line. Files are many and small:
    the tasks of all cores write them in their place, as Spark's writers move each file and set its rights one by one."""
    opened = source.opened

    def run(batches):
        files, place = opened(path)
        key, out = None, None
        for batch in batches:
            for name, line in zip(batch.column("run").to_pylist(), batch.column("value").to_pylist()):
                if name != key:
                    if out:
                        out.close()
                    folder = f"{place}/run={name}"
                    files.create_dir(folder)
                    with files.open_output_stream(f"{folder}/part-1.txt.gz", compression="gzip") as other:
                        other.write(b"step 7\n")
                    key, out = name, files.open_output_stream(f"{folder}/part-0.txt", buffer_size=1 << 16)
                out.write((line or "").encode() + b"\n")
        if out:
            out.close()
        yield from ()

    named = lines.select(F.coalesce("run", F.lit(NO_RUN)).alias("run"), "line_no", "value")
    dealt = named.repartition(LOG_TASKS * lines.sparkSession.sparkContext.defaultParallelism, "run")
    dealt.sortWithinPartitions("run", "line_no").select("run", "value").mapInArrow(run, "done BOOLEAN").count()


@query(f"WITH {S.LINES_SQL} SELECT run, row_number() OVER (PARTITION BY run ORDER BY line_no) AS n, line FROM lines")
def read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text logs, one file for each run, read back in order; a second log of each run is not mixed in."""
    path = scratch_path(spark, "logs")
    lines = S.lines(spark, sf_dir)
    _write_logs(lines.select("run", "line_no", F.concat("line", F.lit(" \t\r")).alias("value")), path)
    read = files.read_logs(spark, path, "part-*.txt").withColumn("run", F.regexp_replace("run", "^run=", ""))
    place = F.row_number().over(W.partitionBy("run").orderBy("line_no"))
    return read.select("run", place.cast("bigint").alias("n"), "line")


#: Rows of a file of a micro-batch.
FILE_ROWS = 1 << 20


def _live_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of log lines that arrives in four micro-batches, in the order of the events."""
    path = scratch_path(spark, "live")
    events = table(spark, sf_dir, "events")
    low, high, n = events.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    quarter = F.floor((F.col("event_id") - F.lit(low)) * BATCHES / F.lit(high - low + 1))
    files = -(-n // (BATCHES * FILE_ROWS))
    for number in range(BATCHES):
        events.where(quarter == number).repartition(files).write.mode("append").parquet(path)
    return S.as_lines(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path))


#: Logs that grow in the query of text logs.
LOGS = 16


def _grow(lines: DataFrame, root: str, whole: bool) -> None:
    """Writes the logs ``{root}/{run}/log.txt`` as long as ``lines`` has them; in part they end inside a line."""

    def run(batches):
        key, out = None, None
        for batch in batches:
            for name, line in zip(batch.column("run").to_pylist(), batch.column("line").to_pylist()):
                if name != key:
                    if out:
                        out.close()
                    files, place = open_root(root)
                    files.create_dir(f"{place}/{name}")
                    key, out = name, files.open_output_stream(f"{place}/{name}/log.txt")
                out.write(line.encode())
        if out:
            out.close()
        yield from ()

    open_root = source.opened
    order = F.row_number().over(W.partitionBy("run").orderBy(F.col("line_no").desc()))
    last = F.when((order == 1) & F.lit(not whole), F.substring("line", 1, 9)).otherwise(F.concat("line", F.lit("\n")))
    dealt = lines.select("run", "line_no", last.alias("line")).repartition("run").sortWithinPartitions("run", "line_no")
    dealt.select("run", "line").mapInArrow(run, "done BOOLEAN").count()


@query(
    f"""WITH {S.LINES_SQL}, dealt AS (SELECT 'log' || (run::BIGINT % {LOGS}) AS run, line_no, line FROM lines)
SELECT run, row_number() OVER (PARTITION BY run ORDER BY line_no) AS n, line FROM dealt"""
)
def stream_text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text logs that grow four times, read by a stream that is started anew each time and finds whole lines only."""
    root = scratch_path(spark, "text-logs")
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    lines = S.lines(spark, sf_dir)
    lines = lines.withColumn("run", F.concat(F.lit("log"), (F.col("run").cast("bigint") % LOGS).cast("string")))
    for number in range(1, BATCHES + 1):
        upto = low + (high - low + 1) * number // BATCHES
        _grow(lines.where(F.col("line_no") < upto), f"{root}/logs", number == BATCHES)
        stream = source.read_live_logs(spark, f"{root}/logs", state=f"{root}/state.json")
        found = _appended(stream, root)
    place = F.row_number().over(W.partitionBy("run").orderBy("line_no"))
    return found.select("run", place.cast("bigint").alias("n"), "line")


def _appended(stream: DataFrame, root: str) -> DataFrame:
    writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
    live.run_to_end(writer)
    return stream.sparkSession.read.parquet(f"{root}/out")


def _published(stream: DataFrame, root: str) -> DataFrame:
    live.run_to_end(live.publish(stream, f"{root}/out", f"{root}/ckpt"))
    return live.published(stream.sparkSession, f"{root}/out", stream.schema)


@query(_PARSED_ROWS_SQL)
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(live.stream_metrics(_live_lines(spark, sf_dir)), scratch_path(spark, "stream-metrics"))


@query(f"WITH {_ASOF_SQL} SELECT * FROM stepped")
def stream_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(live.stream_asof(_live_lines(spark, sf_dir)), scratch_path(spark, "stream-asof"))


@query(f"WITH {_TAIL_SQL} 50")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(live.stream_tail(_live_lines(spark, sf_dir), n=50), scratch_path(spark, "stream-tail"))


@query(f"WITH {_STATUS_SQL} SELECT * FROM status")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(live.stream_status(_live_lines(spark, sf_dir)), scratch_path(spark, "stream-status"))
