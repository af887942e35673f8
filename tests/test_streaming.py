import random

import pytest

from viewloom.operators import logs
from viewloom.streaming import logs as live

from test_logs import LINES, train, val


@pytest.fixture
def fed(spark, tmp_path):
    """Lines of three runs, written as five files in order."""
    rng = random.Random(3)
    data = []
    for run in ("a", "b", "c"):
        for i in range(200):
            kind = rng.random()
            line = val(psnr=str(i), ssim="0.5" if i % 3 else None) if kind < 0.15 else train(i) if kind < 0.6 else f"noise {i}"
            data.append((run, i, line))
    data.sort(key=lambda r: r[1])
    # run c goes quiet in the middle
    parts = [data[k * 120 : (k + 1) * 120] for k in range(5)]
    parts[2] = [r for r in parts[2] if r[0] != "c"]
    source = tmp_path / "in"
    for part in parts:
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(str(source))
    return str(source), spark.createDataFrame([r for p in parts for r in p], LINES), tmp_path


def stream(spark, source):
    return live.read_lines(spark, source, files_per_batch=1)


def same(left, right):
    names = sorted(left.columns)
    key = lambda rows: sorted((tuple(r[n] for n in names) for r in rows), key=str)
    assert key(left.collect()) == key(right.collect())


def test_metrics_stream_equals_batch(spark, fed):
    source, lines, tmp = fed
    live.run_to_end(
        live.stream_metrics(stream(spark, source)).writeStream.format("parquet")
        .option("path", str(tmp / "out")).option("checkpointLocation", str(tmp / "ckpt"))
    )
    same(spark.read.parquet(str(tmp / "out")), logs.parse_lines(lines))


def asof(spark, source, tmp):
    found = live.stream_asof(stream(spark, source))
    writer = found.writeStream.format("parquet").option("path", str(tmp / "out"))
    return live.run_to_end(writer.option("checkpointLocation", str(tmp / "ckpt")))


def test_asof_stream_equals_batch(spark, fed):
    source, lines, tmp = fed
    assert asof(spark, source, tmp) == 4
    same(spark.read.parquet(str(tmp / "out")), logs.asof_step(logs.scan_lines(lines)))


def test_asof_continues_after_a_restart(spark, fed):
    source, lines, tmp = fed
    asof(spark, source, tmp)
    more = spark.createDataFrame([("a", 1000, val("77")), ("c", 1001, train(900)), ("c", 1002, val("78"))], LINES)
    more.coalesce(1).write.mode("append").parquet(source)
    assert asof(spark, source, tmp) == 5
    same(spark.read.parquet(str(tmp / "out")), logs.asof_step(logs.scan_lines(lines.unionByName(more))))


def test_tail_stream_equals_batch(spark, fed):
    source, lines, tmp = fed
    places = (str(tmp / "out"), str(tmp / "ckpt"))
    assert live.run_to_end(live.publish(live.stream_tail(stream(spark, source), 15), *places)) == 4
    same(live.published(spark, places[0], live.LINES), logs.tail_lines(lines, 15))
    # nothing new: the kept lines stay
    assert live.run_to_end(live.publish(live.stream_tail(stream(spark, source), 15), *places)) == -1
    same(live.published(spark, places[0], live.LINES), logs.tail_lines(lines, 15))


def test_a_batch_writes_only_the_runs_it_changed(spark, fed):
    source, lines, tmp = fed
    places = (str(tmp / "out"), str(tmp / "ckpt"))
    live.run_to_end(live.publish(live.stream_tail(stream(spark, source), 15), *places))
    before = {p: p.stat().st_mtime_ns for p in (tmp / "out").rglob("*.parquet")}
    spark.createDataFrame([("b", 5000, "late")], LINES).coalesce(1).write.mode("append").parquet(source)
    live.run_to_end(live.publish(live.stream_tail(stream(spark, source), 15), *places))
    after = {p: p.stat().st_mtime_ns for p in (tmp / "out").rglob("*.parquet")}
    changed = [str(p) for p in after if before.get(p) != after[p]]
    assert {r.run for r in spark.read.parquet(*changed).select("run").distinct().collect()} == {"b"}
    same(live.published(spark, places[0], live.LINES), logs.tail_lines(spark.read.parquet(source), 15))


def test_status_stream_equals_batch(spark, fed):
    source, lines, tmp = fed
    status = live.stream_status(stream(spark, source))
    live.run_to_end(live.publish(status, str(tmp / "out"), str(tmp / "ckpt")))
    same(live.published(spark, str(tmp / "out"), status.schema), logs.run_status(logs.scan_lines(lines)))
