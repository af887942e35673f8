"""Expressions that read one training-log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of a training line and of the validation scores.
TRAIN_LINE = r"\|\s*(\d+)/\d+\s*\[.*?loss=([\d.e+\-]+|nan).*?lr=([\d.e+\-]+)"
SCORE = r"{name}=([\d.e+\-]+)"

_MARK = "\x01"


def is_train_candidate(line: Column) -> Column:
    """Cheap test that spares most lines the regular expression."""
    return F.contains(line, F.lit("loss=")) & F.contains(line, F.lit("lr="))


def train_fields(line: Column) -> Column:
    """['', step, loss, lr] of the first match as text, in one pass; shorter for other lines.

    ``(?s)``: a redrawn progress bar has carriage returns inside the line.
    """
    whole = f"(?s)^.*?{TRAIN_LINE}.*$"
    fields = F.split(F.regexp_replace(line, whole, f"{_MARK}$1{_MARK}$2{_MARK}$3"), _MARK)
    return F.when(is_train_candidate(line), fields)


def number_or_null(text: Column, kind: str) -> Column:
    """``nan`` is no number here: such a loss counts as not reported."""
    return F.when(text != "nan", text).try_cast(kind)


def is_val_candidate(line: Column) -> Column:
    return F.contains(line, F.lit("psnr=")) & F.contains(line, F.lit("lpips="))


def val_score(line: Column, name: str) -> Column:
    text = F.regexp_extract(line, SCORE.format(name=name), 1)
    return F.when(is_val_candidate(line), text).try_cast("double")
