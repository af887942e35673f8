import random
import re

import pytest

from viewloom.functions import logs as L
from viewloom.operators import logs

LINES = "run STRING, line_no BIGINT, line STRING"


def train(step, loss="0.5", lr="1e-05"):
    return f"Training:  1%|#    | {step}/9000 [00:01<10:00, 1.5it/s, ema=0.99, loss={loss}, lr={lr}]"


def val(psnr="20.5", lpips="0.25", ssim="0.9"):
    return f"Validation: 100%|##| 4/4 [00:01<00:00, lpips={lpips}, psnr={psnr}" + (f", ssim={ssim}]" if ssim else "]")


def table(spark, lines, run="r"):
    return spark.createDataFrame([(run, i, line) for i, line in enumerate(lines)], LINES)


def python_parse(line):
    m = re.search(L.TRAIN_LINE, line)
    if not m or m.group(2) == "nan":
        return None
    return int(m.group(1)), float(m.group(2)), float(m.group(3))


ODD_LINES = [
    train(7), train(8, "nan"), train(9, "1.5e-03", "2e+00"), val(), "junk", "", "loss=1 lr=2",
    "| 3/4 [x loss=0.25 y lr=0.5", "|5/6[loss=1,lr=2", "\r  0%| | 1/9 [loss=0.1, lr=0.2]\r 10%| | 2/9 [loss=0.3, lr=0.4]",
    "| 1/2 [a] | 3/4 [loss=9, lr=8", "| 1/2 [render_loss=0.5, loss=0.7, lr=0.1]", "|  12/13 [loss=abc loss=4 lr=x lr=3",
    "a |\t4/5 [loss=+1, lr=-1] trailing | 9/9 [loss=2, lr=2]", "loss=5 | 6/7 [ lr=1",
]


def test_train_lines_match_the_pattern(spark, rows):
    expected = sorted((i, *p) for i, p in ((i, python_parse(x)) for i, x in enumerate(ODD_LINES)) if p)
    assert rows(logs.parse_train(table(spark, ODD_LINES)), "line_no", "step", "loss", "lr") == expected
    assert len(expected) >= 8


def test_validation_lines(spark, rows):
    lines = [val(), val(ssim=None), "psnr=1", "lpips=0.1", train(1), "psnr=1e1 lpips=2e-1 ssim=3"]
    got = rows(logs.parse_val(table(spark, lines)), "line_no", "psnr", "lpips", "ssim")
    assert got == [(0, 20.5, 0.25, 0.9), (1, 20.5, 0.25, None), (5, 10.0, 0.2, 3.0)]


def test_one_line_can_be_both(spark):
    both = train(3) + " psnr=10.0 lpips=0.5"
    parsed = logs.parse_lines(table(spark, [both]))
    assert parsed.count() == 1
    r = logs.asof_step(parsed).first()
    assert (r.step, r.psnr, r.ssim) == (3, 10.0, None)


def walk(lines):
    """What a reader of the log would record."""
    last, out = 0, []
    for i, line in enumerate(lines):
        parsed = python_parse(line)
        if parsed:
            last = parsed[0]
        m = re.search(r"psnr=([\d.e+\-]+)", line)
        if m and "lpips=" in line:
            out.append((i, last, float(m.group(1))))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 64, logs.CHUNK])
def test_asof_equals_reading_in_order(spark, chunk):
    rng = random.Random(chunk)
    runs = {}
    for r in range(4):
        lines = [val(ssim=None)]
        for i in range(150):
            kind = rng.random()
            lines.append(val(psnr=str(i)) if kind < 0.2 else train(i, "nan") if kind < 0.3 else train(i) if kind < 0.7 else "noise")
        runs[f"run{r}"] = lines
    df = spark.createDataFrame([(n, i, x) for n, ls in runs.items() for i, x in enumerate(ls)], LINES)
    got = {}
    for r in logs.asof_step(logs.scan_lines(df), chunk=chunk).orderBy("run", "line_no").collect():
        got.setdefault(r.run, []).append((r.line_no, r.step, r.psnr))
    assert got == {n: walk(ls) for n, ls in runs.items()}
    assert got["run0"][0][1] == 0


def test_carried_step(spark):
    parsed = logs.scan_lines(table(spark, [val(), train(50), val()]))
    carried = spark.createDataFrame([("r", 40), ("other", 1)], "run STRING, step BIGINT")
    assert [r.step for r in logs.asof_step(parsed, carried).orderBy("line_no").collect()] == [40, 50]


def test_tail(spark, rows):
    df = table(spark, [f"l{i}" for i in range(30)]).unionByName(table(spark, ["x"], "short"))
    assert rows(logs.tail_lines(df, 3)) == [("r", 27, "l27"), ("r", 28, "l28"), ("r", 29, "l29"), ("short", 0, "x")]


def test_status_takes_the_latest_of_each(spark):
    lines = [train(1, "0.1"), val("10", "0.5", "0.7"), train(2, "0.2", "3e-4"), val("11", "0.4", None), train(3, "nan"), "end"]
    r = logs.run_status(logs.scan_lines(table(spark, lines))).first()
    assert (r.step, r.loss, r.lr, r.psnr, r.lpips, r.ssim) == (2, 0.2, 3e-4, 11.0, 0.4, 0.7)


def test_metric_rows(spark, rows):
    got = rows(logs.metric_rows(logs.scan_lines(table(spark, [train(5), val(ssim=None)]))), "step", "name", "value")
    assert got == [(5, "training/loss", 0.5), (5, "training/lr", 1e-5), (5, "validation/lpips", 0.25), (5, "validation/psnr", 20.5)]


def test_each_pattern_runs_once(spark):
    plan = logs.parse_lines(table(spark, ODD_LINES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert plan.count("regexp_extract") == 3
