"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query: it can match
only a text that holds all trigrams of one of its alternatives. Postings of
those trigrams are intersected; the texts that remain are verified with the
expression itself. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from viewloom.llm.common import constants, id_text, repeat_rows


class Rule(NamedTuple):
    """A kind of secret: where it may stand, and how many characters group ``group`` of a match must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def either_case(word: str) -> str:
    """A pattern for ASCII letters in either case, the same in every engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
# The base rules, in the order that breaks ties, then this library's own.
# Runs with a least length need no group: a maximal run that is too short holds no other match.
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

#: A part that would make more alternatives than this counts as unknown, which only adds candidates.
MOST_ALTERNATIVES = 64
GAP = "\0"


def _alternatives(nodes) -> list[str]:
    """Strings that a match must hold, with GAP for what is not known; one string for each alternative."""
    found = [""]
    for op, arg in nodes:
        own = _alternatives_of(op, arg)
        found = [a + b for a in found for b in (own if len(found) * len(own) <= MOST_ALTERNATIVES else [GAP])]
    return found


def _alternatives_of(op, arg) -> list[str]:
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg):
        letters = sorted({chr(c).lower() for _, c in arg})
        return letters if len(letters) <= 8 else [GAP]
    if op is sre.SUBPATTERN:
        return _alternatives(arg[-1])
    if op is sre.BRANCH:
        return [x for branch in arg[1] for x in _alternatives(branch)]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        if (low, high) == (0, 1):
            return ["", *_alternatives(inner)]
        if low == 0:
            return [GAP]
        ends = [x + GAP for x in _alternatives(inner)]
        return _alternatives(inner) if (low, high) == (1, 1) else ends
    return [""] if op is sre.AT else [GAP]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams, one of which is in every text that the pattern matches.

    Empty if some alternative has no mandatory trigram.
    """
    clauses = set()
    for text in _alternatives(_parser.parse(pattern)):
        parts = text.split(GAP)
        clauses.add(frozenset(p[i : i + 3] for p in parts for i in range(len(p) - 2) if p.isascii()))
    needed = {c for c in clauses if not any(other < c for other in clauses)}
    return sorted(needed, key=sorted) if frozenset() not in needed else []


def clause_rows(rules=RULES) -> list[tuple]:
    """(rule, clause, trigram, its bit, all bits of the clause)."""
    rows = []
    for n, rule in enumerate(rules):
        for k, clause in enumerate(trigram_query(rule.pattern)):
            if len(clause) > 62:
                clause = sorted(clause)[:62]  # fewer conditions: more candidates, no match lost
            rows += [(n, k, t, 1 << i, (1 << len(clause)) - 1) for i, t in enumerate(sorted(clause))]
    return rows


def _lookahead(trigrams: list[str]) -> str:
    """A pattern that stops before each of the trigrams, in either case, and captures it."""
    starts: dict[str, list[str]] = {}
    for t in trigrams:
        starts.setdefault(t[0], []).append(re.escape(t[1:]))
    return "(?i)(?=(" + "|".join(f"{re.escape(a)}(?:{'|'.join(rest)})" for a, rest in sorted(starts.items())) + "))"


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, thash): which texts hold which of the trigrams that some rule asks for."""
    held = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_lookahead(trigrams)), F.lit(1)), F.lower))
    return texts.select(F.explode(held).alias("trigram"), "doc_id", "thash")


def candidates(texts: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, thash, rules): the texts that hold a clause of some rule, with a bit for each such rule."""
    rows = clause_rows(rules)
    clauses = constants(texts.sparkSession, rows, "rule, clause, trigram, bit, need")
    return (
        postings(texts, sorted({r[2] for r in rows}))
        .join(F.broadcast(clauses), "trigram")
        .groupBy("doc_id", "thash", "rule", "clause", "need")
        .agg(F.bit_or(F.col("bit").cast("long")).alias("held"))
        .where(F.col("held") == F.col("need"))
        .groupBy("doc_id", "thash")
        .agg(F.expr("bit_or(shiftleft(1L, rule))").alias("rules"))
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Secrets in every whole text; one row for each input row.

    Result: doc_id, n_<kind> for each base rule, base_spans, spans (kind:start:end in code points, end exclusive,
    by start and then in the order of the rules, comma-joined) and found (the same as an array of structs).
    Null and empty texts have no spans and zero counts; a null id stays null. Repeated rows give repeated results.
    Other columns are not read, whatever they are called. No row gives no row.

    The text is read twice (postings, verification) and shuffled once, to meet its candidate bits. Of a rule's
    postings only those trigrams are kept that some rule asks for. The clauses are constants of the rules.
    """
    texts = id_text(docs, id_col, text_col).withColumn("thash", F.xxhash64("text"))
    queries = [trigram_query(r.pattern) for r in rules]
    if any(queries):
        same = F.expr("t.doc_id <=> c.doc_id AND t.thash = c.thash")
        joined = texts.alias("t").join(candidates(texts, rules).alias("c"), same, "left")
        texts = joined.select("t.doc_id", "t.thash", "text", "rules")
    else:
        texts = texts.withColumn("rules", F.lit(0).cast("long"))

    nothing = F.array().cast("array<string>")
    hits = [F.col("doc_id"), F.col("thash")]
    for n, rule in enumerate(rules):
        matches = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        if queries[n]:
            asked = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << n)) != 0
            matches = F.when(asked, matches).otherwise(nothing)
        hits.append(matches.alias(f"m{n}"))
    texts = texts.select(*hits, "text")
    spots = F.concat(*(_spots(n, rule) for n, rule in enumerate(rules)))
    each = texts.select("doc_id", "thash", F.explode_outer(spots).alias("s")).select("doc_id", "thash", "s.*")

    each = each.groupBy("doc_id", "thash", "rule", "k").agg(
        F.max("before").alias("before"), F.max("chars").alias("chars"), F.max("ok").alias("ok"), F.count(F.lit(1)).alias("rows")
    )
    line = Window.partitionBy("doc_id", "thash", "rule").orderBy("k")
    end = F.sum(F.col("before") + F.col("chars")).over(line)
    kinds = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("rule") + 1)
    each = each.repartition("doc_id", "thash").withColumn("end", end).withColumn("start", F.col("end") - F.col("chars"))
    span = F.struct("start", "rule", "end", kinds.alias("kind"))
    n_base = sum(r.base for r in rules)
    if not all(r.base for r in rules[:n_base]):
        raise ValueError("base rules come first")
    found = each.groupBy("doc_id", "thash").agg(
        *(
            F.sum(F.when((F.col("rule") == n) & F.col("ok"), 1).otherwise(0)).cast("long").alias(f"n_{r.kind}")
            for n, r in enumerate(rules[:n_base])
        ),
        F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("found"),
        F.max("rows").alias("rows"),
    )
    found = found.withColumn("base_spans", _told(F.filter("found", lambda s: s["rule"] < n_base)))
    return repeat_rows(found.withColumn("spans", _told(F.col("found"))), "rows").drop("thash")


def _spots(n: int, rule: Rule) -> Column:
    """(rule, number of the match, characters between it and the one before, its characters, whether it counts)."""
    matches = F.col(f"m{n}")
    value = (lambda m: F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else (lambda m: m)
    between = F.split("text", rule.pattern, -1)
    spots = F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b")),
        lambda x, i: F.struct(
            F.lit(n).alias("rule"),
            i.alias("k"),
            F.char_length(x["b"]).cast("long").alias("before"),
            F.char_length(x["m"]).cast("long").alias("chars"),
            (F.char_length(value(x["m"])) >= rule.least).alias("ok"),
        ),
    )
    kind = "array<struct<rule:int,k:int,before:bigint,chars:bigint,ok:boolean>>"
    return F.when(F.size(matches) > 0, spots.cast(kind)).otherwise(F.array().cast(kind))


def _told(spans: Column) -> Column:
    def tell(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, tell), ",")


COLUMNS = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).select(*COLUMNS)


def oracle(rules=RULES) -> str:
    """The same result in DuckDB SQL: every rule scans every text."""
    parts = []
    for n, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        value = f"regexp_extract(m, '{pattern}', {r.group})" if r.group else "m"
        parts.append(
            f"SELECT rid, {n} AS rule, '{r.kind}' AS kind, k, length(m) AS chars, length(b) AS before,"
            f" length({value}) >= {r.least} AS ok FROM (SELECT rid, unnest(ms) AS m,"
            f" unnest(bs[:len(ms)]) AS b, unnest(range(len(ms))) AS k FROM (SELECT rid,"
            f" regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS bs FROM docs))"
        )
    n_base = sum(r.base for r in rules)
    counts = ", ".join(f"count(*) FILTER (rule = {n}) AS n_{r.kind}" for n, r in enumerate(rules[:n_base]))
    shown = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in rules[:n_base])
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rule)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
spans AS (
  SELECT *, sum(before + chars) OVER (PARTITION BY rid, rule ORDER BY k)::BIGINT AS e, e - chars AS s FROM hits),
found AS (
  SELECT rid, {counts}, {told} FILTER (rule < {n_base}) AS base, {told} AS spans FROM spans WHERE ok GROUP BY rid)
SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (rid)
"""
