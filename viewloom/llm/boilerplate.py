"""Line dedup by site-relative frequency.

A line that stands on more than a share of its host's pages is boilerplate of that host and is dropped there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import fresh, quoted
from viewloom.session import scratch_path

#: A line must stand on more than this share of a host's pages, and on two at least: one page shows no boilerplate.
MAX_RATIO, MIN_PAGES = 0.1, 2
#: Boilerplate lines of which the hashes are sent to every task; more are joined by host.
BROADCAST_LINES = 100_000


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _text(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def boilerplate(
    docs: DataFrame, host_col: str, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, line, pages, total): hashes of the lines on more than ``max_ratio`` of a host's pages.

    A page is a distinct text of the host: copies of one page do not make its lines boilerplate. A line counts once
    a page, without blanks around it; blank lines never count.
    """
    lines = F.filter(F.split(_text(text_col), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    pages = docs.where(quoted(host_col).isNotNull()).select(
        quoted(host_col).alias("host"),
        F.xxhash64(_text(text_col)).alias("page"),
        F.array_distinct(F.transform(lines, _line_hash)).alias("lines"),
    )
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    seen = pages.select("host", "page", F.explode("lines").alias("line"))
    often = seen.groupBy("host", "line").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= min_pages)
    return often.join(totals, "host").where(F.col("pages") > F.col("total") * max_ratio)


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    dropped_col: str | None = None,
) -> DataFrame:
    """``docs`` without the boilerplate lines of each host; all rows and columns stay.

    ``dropped_col`` names a further column for the number of lines dropped. A text without boilerplate stays as it
    is, to the letter; one that is nothing else becomes empty. A null text becomes empty; a row without a host stays
    as it is, since it has no site to compare with. Repeated rows are one page and get the same result. No row gives
    no row.

    Of each host at most (lines of a page / ratio) lines can be boilerplate, so its list fits a row. The lists of all
    hosts are broadcast only if they are counted to be few; else they are joined by host, where a host with a large
    part of the rows is split by adaptive execution.
    """
    spark = docs.sparkSession
    host, bad, old, kept = fresh(docs, "host", "bad", "old_lines", "kept_lines")
    path = scratch_path(spark, "boilerplate")
    boilerplate(docs, host_col, text_col, max_ratio, min_pages).write.parquet(path)
    found = spark.read.parquet(path)
    few = found.count() <= BROADCAST_LINES
    lists = found.groupBy(F.col("host").alias(host)).agg(F.collect_list("line").alias(bad))
    joined = docs.join(F.broadcast(lists) if few else lists, quoted(host_col) == F.col(host), "left")
    split = joined.withColumn(old, F.split(_text(text_col), "\n"))
    own = F.filter(old, lambda x: ~F.array_contains(bad, _line_hash(x)))
    split = split.withColumn(kept, F.when(F.col(bad).isNull(), F.col(old)).otherwise(own))
    columns = [
        F.array_join(kept, "\n").alias(c) if c == text_col else quoted(c) for c in docs.columns if c != dropped_col
    ]
    if dropped_col is not None:
        columns.append((F.size(old) - F.size(kept)).cast("long").alias(dropped_col))
    return split.select(*columns)


ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
pages AS (SELECT DISTINCT source, text FROM docs WHERE source IS NOT NULL),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY 1),
lines AS (
  SELECT source, text, unnest(list_distinct([trim(x, ' ' || chr(9) || chr(13)) FOR x IN string_split(text, chr(10))]))
    AS line FROM pages),
bad AS (
  SELECT source, list(line) AS bad FROM (
    SELECT source, line, count(*) AS pages FROM lines WHERE line <> '' GROUP BY 1, 2) JOIN totals USING (source)
  WHERE pages >= {MIN_PAGES} AND pages > total * {MAX_RATIO}::DOUBLE GROUP BY 1),
cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS old,
    [x FOR x IN string_split(text, chr(10))
     IF NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(13)))] AS kept
  FROM docs LEFT JOIN bad USING (source))
SELECT doc_id, array_to_string(kept, chr(10)) AS text, (len(old) - len(kept))::BIGINT AS n_dropped FROM cut
"""
