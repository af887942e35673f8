"""Quality by weak supervision: rules vote or abstain, and their accuracies are learned without labels.

Expectation-maximisation runs on the counts of vote patterns, of which there are at most 3 to the number of rules,
whatever the size of the corpus. A document's posterior probability of being good replaces all-must-pass filtering.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import add_columns, fresh, id_text, quoted, texts_of
from viewloom.session import scratch_path

BLANKS, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
#: What is not a mark: blanks, ASCII letters, and everything beyond ASCII.
NO_MARKS = bytes(b for b in range(256) if b > 127 or chr(b) in BLANKS or chr(b).isalpha())
ENDINGS = (".", "!", "?", "…", ":", ";", '"', "'", ")", "»", "”")
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_ended_lines", "n_marks",
)
FIELDS = ", ".join(f"{c}: long" for c in COUNTS)


class Rule(NamedTuple):
    """When a rule says bad and when it says good, in SQL on the counts; it abstains between."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words AND n_words > 0"),
    Rule("letters", "100 * n_marks > 8 * word_chars", "100 * n_marks <= 5 * word_chars AND word_chars > 0"),
    Rule("repeats", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words AND n_words >= 20"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    Rule("capitals", "5 * n_upper_words > n_words", "20 * n_upper_words <= n_words AND n_words > 0"),
    Rule(
        "word length",
        "word_chars < 2.5 * n_words OR word_chars > 12 * n_words",
        "word_chars BETWEEN 3 * n_words AND 9 * n_words AND n_words > 0",
    ),
    Rule("sentences", "10 * n_ended_lines < n_lines", "2 * n_ended_lines >= n_lines AND n_lines > 0"),
)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

#: The posterior from which a document is kept, rounds of the estimate, and votes a rule has beforehand each way.
THRESHOLD, ROUNDS, PRIOR_RIGHT, PRIOR_WRONG = 0.5, 200, 4.0, 1.0


def counts(text: str) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS."""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        once, twice = set(), set()
        for w in windows:
            (twice if w in once else once).add(w)
        covered = 0
        for k, w in enumerate(windows):
            if w in twice:
                repeated += k + 3 - max(k, covered)
                covered = k + 3
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        sum(w.isupper() for w in words),
        sum(line.rstrip(BLANKS).endswith(ENDINGS) for line in lines),
        len(raw.translate(None, NO_MARKS)),
    )


def count_columns(docs: DataFrame, text_col: str, name: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct of the counts of each whole text; a null text is empty."""

    def make():
        def new(batch):
            found = [counts(t or "") for texts in texts_of(batch, text_col) for t in texts]
            values = np.array(found, np.int64).reshape(-1, len(COUNTS))
            return [pa.StructArray.from_arrays([pa.array(v) for v in values.T], names=list(COUNTS))]

        return new

    return add_columns(docs, f"`{name}` struct<{FIELDS}>", make, keep)


def on_counts(sql: str, struct: str | None = None) -> Column:
    """A condition on the counts, which are columns or fields of the column ``struct``."""
    if struct is not None:
        sql = re.sub(rf"\b({'|'.join(COUNTS)})\b", rf"`{struct}`.\1", sql)
    return F.expr(sql)


def pattern(rules=RULES, struct: str | None = None) -> Column:
    """The votes as a string: one of - + 0 for each rule."""
    return F.concat(
        *(F.when(on_counts(r.bad, struct), "-").when(on_counts(r.good, struct), "+").otherwise("0") for r in rules)
    )


class Estimate(NamedTuple):
    """Share of good documents; for each rule how often it votes good, and bad, on good and on bad documents."""

    good: float
    plus_on_good: np.ndarray
    plus_on_bad: np.ndarray
    minus_on_good: np.ndarray
    minus_on_bad: np.ndarray
    posterior: dict[str, float]


def fit(pattern_counts: dict[str, int], rounds: int = ROUNDS) -> Estimate:
    """Expectation-maximisation over vote patterns; an abstention says nothing.

    Votes are independent given the class. A vote that would speak against its meaning counts as no evidence, so
    a document on which nobody votes bad never falls below the share of good documents. Each rule starts with a few
    votes that are right, so that a rule that never votes, or a tiny corpus, has defined accuracies.
    """
    if not pattern_counts:
        return Estimate(0.5, *(np.empty(0),) * 4, {})
    names = sorted(pattern_counts)
    weight = np.array([pattern_counts[n] for n in names], float)
    plus = np.array([[v == "+" for v in n] for n in names], bool).reshape(len(names), -1)
    minus = np.array([[v == "-" for v in n] for n in names], bool).reshape(len(names), -1)
    posterior = np.where(minus.any(1), 0.1, 0.9)
    share, rates = 0.5, (np.full(plus.shape[1], 0.5),) * 4
    for _ in range(rounds):
        good, bad = weight * posterior, weight * (1 - posterior)
        share = (good.sum() + 1) / (weight.sum() + 2)
        total = PRIOR_RIGHT + PRIOR_WRONG
        plus_good = (good @ plus + PRIOR_RIGHT) / (good.sum() + total)
        plus_bad = np.minimum((bad @ plus + PRIOR_WRONG) / (bad.sum() + total), plus_good)
        minus_bad = (bad @ minus + PRIOR_RIGHT) / (bad.sum() + total)
        minus_good = np.minimum((good @ minus + PRIOR_WRONG) / (good.sum() + total), minus_bad)
        rates = plus_good, plus_bad, minus_good, minus_bad
        odds = np.log(share / (1 - share)) + plus @ np.log(plus_good / plus_bad) + minus @ np.log(minus_good / minus_bad)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return Estimate(float(share), *rates, dict(zip(names, posterior.tolist())))


def learn(counted: DataFrame, rules=RULES) -> Estimate:
    """Fits the rules on the vote patterns of all documents that do not fail anyway; ``counted`` has the counts."""
    if not 0 < len(rules) <= 8:
        raise ValueError("one to eight rules")
    open_cases = counted.where(f"NOT ({BASE_FAILED})")
    rows = open_cases.groupBy(pattern(rules).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** 8 at most
    return fit({r["p"]: r["n"] for r in rows})


def _judged(counted: DataFrame, votes: str, estimate: Estimate, posterior: str) -> DataFrame:
    """Adds the posterior of each vote pattern, 0 for one that nothing was learned of; at most 3 ** 8 rows are sent."""
    rows = list(estimate.posterior.items())
    known = counted.sparkSession.createDataFrame(rows, f"`{votes}` string, `{posterior}` double")
    judged = counted.join(F.broadcast(known), votes, "left")
    return judged.withColumn(posterior, F.coalesce(posterior, F.lit(0.0)))


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, threshold: float = THRESHOLD
) -> DataFrame:
    """Counts, votes and verdict on every whole text; one row for each input row.

    Result: doc_id, the counts, votes, posterior, base_failed (fewer than 50 words, or over half of them in repeated
    3-word windows) and kept (not base_failed, and posterior >= ``threshold``). Null and empty texts have zero counts
    and fail. A null id stays null; repeated rows are counted and give repeated results. Other columns are not read,
    whatever they are called. No row gives no row.

    Texts are read once; the counts are stored, their vote patterns are aggregated, and only those reach the driver.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "counts")
    count_columns(id_text(docs, id_col, text_col), "text", "c", ["doc_id"]).select("doc_id", "c.*").write.parquet(path)
    counted = spark.read.parquet(path).withColumn("votes", pattern(rules))
    judged = _judged(counted, "votes", learn(counted, rules), "posterior").withColumn("base_failed", F.expr(BASE_FAILED))
    kept = ~F.col("base_failed") & (F.col("posterior") >= threshold)
    return judged.select("doc_id", *COUNTS, "votes", "posterior", "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` would keep, with all their columns.

    Texts are read twice, to learn and to judge; nothing but vote patterns is shuffled.
    """
    c, votes, posterior = fresh(docs, "counts", "votes", "posterior")
    texts = docs.select(quoted(text_col).cast("string").alias("text"))
    estimate = learn(count_columns(texts, "text", "c", []).select("c.*"), rules)
    counted = count_columns(docs, text_col, c).where(~on_counts(BASE_FAILED, c))
    judged = _judged(counted.withColumn(votes, pattern(rules, c)), votes, estimate, posterior)
    return judged.where(F.col(posterior) >= threshold).select(*map(quoted, docs.columns))


COLUMNS = ("doc_id", *COUNTS[:3], "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
