import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from viewloom.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


TEXTS = ["a b c a b c", "a b a b a b a", "x y\x85z w\x1cv", "a\n\na\n a \na", "#*$ %&| <> 😀", "u v w " * 40, "One two.\r\nOne two.\r\n"]


def test_counts_equal_brute_force(spark, tricky, pairs, by_rows):
    more = spark.createDataFrame(list(enumerate(TEXTS, 100)), "doc_id long, text string")
    docs = tricky.select("doc_id", "text").union(more)
    got = quality.score_documents(docs).select("doc_id", *quality.COLUMNS[1:7])
    assert by_rows(got.collect()) == by_rows((i, *brute(t)) for i, t in [*pairs, *enumerate(TEXTS, 100)])


def test_estimate_finds_the_odd_ones():
    fitted = quality.fit({"++++": 900, "+0++": 50, "--++": 60, "-+++": 8, "+-++": 8, "++0+": 5})
    assert fitted.posterior["++++"] > 0.9 and fitted.posterior["--++"] < 0.5
    assert 0.8 < fitted.good < 1


@pytest.mark.parametrize("counts", [{}, {"+": 1}, {"0": 5}, {"-": 3}, {"": 2}])
def test_estimate_of_little(counts):
    fitted = quality.fit(counts)
    assert set(fitted.posterior) == set(counts) and all(0 <= p <= 1 for p in fitted.posterior.values())


def test_a_document_without_a_bad_vote_is_not_below_the_share():
    fitted = quality.fit({"+++": 500, "00+": 40, "000": 10, "-0+": 300, "0--": 100})
    assert min(fitted.posterior[p] for p in ("+++", "00+", "000")) >= fitted.good - 1e-9


def test_held_out_labels(spark):
    """The verdict learned without labels agrees with them."""
    sf = "/root/testdata/sf0.01"
    found = quality.score_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = found.where("NOT base_failed").join(labels, "doc_id")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.97


def test_filter_keeps_what_the_score_keeps(tricky, by_rows):
    kept = quality.keep_good(tricky)
    assert kept.columns == tricky.columns
    want = [r.doc_id for r in quality.score_documents(tricky).collect() if r.kept]
    assert by_rows((r.doc_id,) for r in kept.select("doc_id").collect()) == by_rows((i,) for i in want)


def test_no_rows(nothing):
    assert quality.score_documents(nothing).count() == 0
    assert quality.keep_good(nothing).count() == 0
