import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from viewloom.operators import logs
from viewloom.sources import live as source
from viewloom.streaming import logs as live

from test_logs import train, val


def grow(root, run, text, mode="a"):
    (root / run).mkdir(parents=True, exist_ok=True)
    with open(root / run / "log.txt", mode, newline="") as f:
        f.write(text)


def drain(spark, tmp_path, **more):
    """Reads what there is, as a query that was started anew."""
    lines = source.read_live_logs(spark, str(tmp_path / "logs"), **more)
    writer = lines.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    live.run_to_end(writer.option("checkpointLocation", str(tmp_path / "ckpt")))
    got = spark.read.schema(source.SCHEMA).parquet(str(tmp_path / "out")).orderBy("run", "line_no").collect()
    out = {}
    for r in got:
        out.setdefault(r.run, []).append(r.line)
    assert len({(r.run, r.line_no) for r in got}) == len(got)
    return out


def test_lines_come_once_as_logs_grow(spark, tmp_path):
    """Restarts between all appends; a line without an end waits; new logs join; nothing new is no batch."""
    root = tmp_path / "logs"
    grow(root, "a", "one\ntwo\nthr")
    assert drain(spark, tmp_path) == {"a": ["one", "two"]}
    grow(root, "a", "ee  \r\n\nfour\n")
    grow(root, "b", "é1\n")
    assert drain(spark, tmp_path) == {"a": ["one", "two", "three", "", "four"], "b": ["é1"]}
    assert drain(spark, tmp_path) == {"a": ["one", "two", "three", "", "four"], "b": ["é1"]}
    grow(root, "b", "é2")
    assert drain(spark, tmp_path)["b"] == ["é1"]
    grow(root, "b", "\n")
    assert drain(spark, tmp_path)["b"] == ["é1", "é2"]


def test_a_log_that_starts_anew(spark, tmp_path):
    root, state = tmp_path / "logs", str(tmp_path / "state.json")
    grow(root, "a", "first\n" + "x\n" * 50)
    drain(spark, tmp_path, state=state)
    grow(root, "a", "second\ny\n", "w")  # shorter
    assert drain(spark, tmp_path, state=state)["a"] == ["first"] + ["x"] * 50 + ["second", "y"]
    grow(root, "a", "third\n" + "z\n" * 99, "w")  # longer
    assert drain(spark, tmp_path, state=state)["a"][-101:] == ["y", "third"] + ["z"] * 99
    grow(root, "a", "end\n")
    assert drain(spark, tmp_path, state=state)["a"][-2:] == ["z", "end"]


def test_status_of_growing_logs_equals_batch(spark, tmp_path, rows):
    root, all_lines = tmp_path / "logs", []
    for turn in range(3):
        for run in ("a", "b"):
            new = [train(100 * turn + k, "0.5") for k in range(20)] + [val(psnr=str(turn))]
            grow(root, run, "\n".join(new) + "\n")
            all_lines += [(run, len(all_lines) + k, line) for k, line in enumerate(new)]
        status = live.stream_status(source.read_live_logs(spark, str(root)))
        places = str(tmp_path / "status"), str(tmp_path / "ckpt-status")
        live.run_to_end(live.publish(status, *places))
    want = logs.run_status(logs.scan_lines(spark.createDataFrame(all_lines, live.LINES)))
    assert rows(live.published(spark, places[0], status.schema)) == rows(want)


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
@pytest.mark.parametrize("cut", [1, 4, 7, 100])
def test_ranges_share_lines(monkeypatch, block, cut):
    """Wherever a log is cut, each whole line is read once, at its position."""
    monkeypatch.setattr(source, "BLOCK", block)
    text = b"a\n\nbcd\nefghijkl\n\n\nm\nunfinished"
    want, at = [], 0
    for line in text.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    file = pa.PythonFile(io.BytesIO(text), mode="r")
    assert source.last_line_end(file, 0, len(text)) == at
    got = []
    for low in range(0, at, cut):
        got += list(source.whole_lines(file, low, min(low + cut, at)))
    assert got == want


def test_whole_lines_of_a_large_log_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "RANGE", 1000)
    root = tmp_path / "logs"
    grow(root, "a", "".join(f"line {k}\n" for k in range(2000)))
    assert drain(spark, tmp_path)["a"] == [f"line {k}" for k in range(2000)]
    reader = source.LiveReader({"path": str(root)})
    assert len(reader.partitions({}, reader.latestOffset())) > 10
