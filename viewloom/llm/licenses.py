"""License scans by diagonal voting.

Every pair of neighbouring words is a gram. Grams are joined with the grams of
the license notices; a hit votes for (notice, offset of the notice in the
text), its diagonal. Neighbouring diagonals (a word added or left out shifts
the rest) are merged, and the words they cover together decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewloom.llm.common import ascii_lower, constants, id_text, repeat_rows, values_sql

# The base phrases with their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Opening words of public license notices, at most 64 words each.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files",
        "mit",
    ),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of "
        "the gnu general public license as published by the free software foundation",
        "gpl",
    ),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        "bsd",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without "
        "fee is hereby granted",
        "isc",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: A word: digits, letters, and everything beyond ASCII. Upper case is folded later, on the words that matter.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP, MIN_COVERAGE = 3, 0.8


def templates(base=BASE, notices=NOTICES) -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, is a base phrase, words) of each phrase."""
    phrases = [(text, label, True) for text, label in base] + [(text, label, False) for text, label in notices]
    out = [(n, label, exact, text.split()) for n, (text, label, exact) in enumerate(phrases)]
    if any(not 2 <= len(words) <= 64 for *_, words in out):
        raise ValueError("a phrase has 2 to 64 words")
    return out


def gram_rows(phrases) -> list[tuple]:
    """(template, position, word, next word), after a row that every text's last word matches."""
    grams = [(n, i, a, b) for n, _, _, w in phrases for i, (a, b) in enumerate(zip(w, w[1:]))]
    return [(-1, 0, None, None), *grams]


def phrase_rows(phrases) -> list[tuple]:
    return [(-1, None, False, 1), *((n, label, exact, len(w) - 1) for n, label, exact, w in phrases)]


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base=BASE,
    notices=NOTICES,
    gap: int = GAP,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """License notices in every whole text; one row for each input row.

    Base phrases count where their words stand consecutively. Another notice counts where neighbouring
    diagonals (at most ``gap`` words apart) cover ``min_coverage`` of its grams within a span that is not
    longer than the notice divided by ``min_coverage``, or one diagonal does so alone.

    Result: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best coverage of a
    notice that counts, else 0) and spans (label, start, end, coverage; words from 0, end exclusive).
    Null and empty texts have no words, zero counts, empty labels and score 0; a null id stays null. Repeated
    rows give repeated results. Other columns are not read, whatever they are called. No row gives no row.

    One pass over the text; only hits and one row for each text are shuffled. The grams of the phrases are
    constants of this module or arguments, so their broadcast does not grow with the data.
    """
    spark = docs.sparkSession
    phrases = templates(base, notices)
    grams = constants(spark, gram_rows(phrases), "template, tpos, ta, tb").withColumn(
        "gram", F.when(F.col("tb").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("ta", "tb"))
    )
    about = constants(spark, phrase_rows(phrases), "template, label, exact, grams")

    words = id_text(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("thash"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w")
    )
    # the last pair has no second word: it marks the text itself and tells its number of words
    pairs = words.select(
        "doc_id",
        "thash",
        F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, greatest(size(w), 1))").alias("b"))),
    ).select("doc_id", "thash", "pos", F.col("col.a").alias("a"), F.col("col.b").alias("b"))
    keyed = pairs.withColumn(
        "gram",
        F.when(F.col("b").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lower("a"), F.lower("b"))),
    )
    same = F.when(F.col("tb").isNull(), F.col("b").isNull()).otherwise(
        (ascii_lower(F.col("a")) == F.col("ta")) & (ascii_lower(F.col("b")) == F.col("tb"))
    )
    votes = keyed.join(F.broadcast(grams), "gram").where(same)

    diagonals = (
        votes.groupBy("doc_id", "thash", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(
            F.expr("bit_or(shiftleft(1L, tpos))").alias("seen"),
            F.count(F.lit(1)).alias("rows"),
            F.min("pos").alias("first"),
            F.max("pos").alias("last"),
        )
        .withColumn("diagonal", F.coalesce("diagonal", F.lit(0)))
        .repartition("doc_id", "thash")
    )
    # in one text and template, diagonals less than the gap apart belong together
    line = Window.partitionBy("doc_id", "thash", "template").orderBy("diagonal")
    marker = F.col("template") < 0
    runs = (
        diagonals.withColumn("cut", (F.col("diagonal") - F.lag("diagonal").over(line) > gap).cast("int"))
        .withColumn("run", F.when(marker, 0).otherwise(F.sum(F.coalesce("cut", F.lit(0))).over(line)))
        .join(F.broadcast(about), "template")
    )
    full = F.col("exact") & (F.bit_count("seen") == F.col("grams"))
    spans = (
        runs.groupBy("doc_id", "thash", "template", "run", "label", "exact", "grams")
        .agg(
            F.expr("bit_count(bit_or(seen))").alias("covered"),
            F.max(F.bit_count("seen")).alias("alone"),
            F.min("first").alias("start"),
            (F.max("last") + 2).alias("end"),
            F.sum(full.cast("long")).alias("places"),
            F.min(F.when(full, F.col("diagonal"))).alias("first_place"),
            F.max(F.when(full, F.col("diagonal"))).alias("last_place"),
            F.max("rows").alias("rows"),
            F.max("last").alias("last"),
        )
    )
    short = F.col("end") - F.col("start") <= (F.col("grams") + 1) / min_coverage
    best = F.when(short, F.col("covered")).otherwise(F.col("alone")) / F.col("grams")
    marker_row = F.col("template") < 0
    counts = F.when(F.col("exact"), F.col("places") > 0).otherwise(best >= min_coverage) & ~marker_row
    told = spans.withColumn("best", F.when(F.col("exact"), F.lit(1.0)).otherwise(best)).withColumn("counts", counts)
    base_hit = F.col("exact") & F.col("counts")
    out = told.groupBy("doc_id", "thash").agg(
        F.coalesce(F.max(F.when(marker_row, F.col("last").cast("long") + 1)), F.lit(0).cast("long")).alias("n_words"),
        F.sum("places").alias("n_base"),
        F.min(F.col("first_place").cast("long")).alias("first_word"),
        F.max(F.col("last_place").cast("long")).alias("last_word"),
        _joined(F.when(base_hit, F.col("label"))).alias("base_labels"),
        _joined(F.when(F.col("counts"), F.col("label"))).alias("labels"),
        F.max(F.when(F.col("counts"), F.col("best")).otherwise(F.lit(0.0))).alias("score"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("counts"),
                    F.struct(
                        F.col("start").cast("long").alias("start"),
                        F.col("end").cast("long").alias("end"),
                        "label",
                        F.col("best").alias("coverage"),
                    ),
                )
            )
        ).alias("spans"),
        F.max(F.when(marker_row, F.col("rows"))).alias("rows"),
    )
    return repeat_rows(out, "rows").drop("thash")


def _joined(label):
    return F.array_join(F.array_sort(F.collect_set(label)), ",")


COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle(gap: int = GAP, min_coverage: float = MIN_COVERAGE) -> str:
    """The same result in DuckDB SQL, from the same constants."""
    phrases = templates()
    return f"""
WITH grams AS ({values_sql(gram_rows(phrases)[1:], "template, tpos, ta, tb")}),
about AS ({values_sql(phrase_rows(phrases)[1:], "template, label, exact, grams")}),
words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT rid, unnest(w) AS a, unnest(w[2:] || [NULL]) AS b, unnest(range(len(w))) AS pos FROM words),
diagonals AS (
  SELECT rid, template, pos - tpos AS diagonal, bit_or(1::BIGINT << tpos::INT) AS seen,
         min(pos) AS first, max(pos) + 2 AS last
  FROM places JOIN grams ON a = ta AND b = tb GROUP BY 1, 2, 3),
cuts AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {gap}
                 THEN 1 ELSE 0 END AS cut FROM diagonals),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM cuts),
spans AS (
  SELECT rid, template, label, exact, grams, run, bit_count(bit_or(seen)) AS covered, max(bit_count(seen)) AS alone,
         max(last) - min(first) AS span, count(*) FILTER (exact AND bit_count(seen) = grams) AS places,
         min(diagonal) FILTER (exact AND bit_count(seen) = grams) AS first_place,
         max(diagonal) FILTER (exact AND bit_count(seen) = grams) AS last_place
  FROM runs JOIN about USING (template) GROUP BY ALL),
best AS (
  SELECT *, CASE WHEN exact THEN 1.0::DOUBLE
                 WHEN span <= (grams + 1) / {min_coverage}::DOUBLE THEN covered::DOUBLE / grams
                 ELSE alone::DOUBLE / grams END AS best FROM spans),
told AS (
  SELECT *, CASE WHEN exact THEN places > 0 ELSE best >= {min_coverage}::DOUBLE END AS counts FROM best),
result AS (
  SELECT rid, sum(places) AS n_base, min(first_place) AS first_word, max(last_place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND counts) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (counts) AS labels,
         max(CASE WHEN counts THEN best ELSE 0.0 END) AS score
  FROM told GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM words LEFT JOIN result USING (rid)
"""
