import hashlib
import random
import string
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from viewloom.llm import merkle

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grown(leaves):
    """The root over some leaves, and the siblings of each, level by level."""
    proofs, below, now = [[] for _ in leaves], [[k] for k in range(len(leaves))], list(leaves)
    while len(now) > 1:
        up, over = [], []
        for a in range(0, len(now), 8):
            run = now[a : a + 8]
            for k in range(len(run)):
                for leaf in below[a + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(digest(*run))
            over.append([leaf for own in below[a : a + 8] for leaf in own])
        now, below = up, over
    return now[0], proofs


def by_hand(rows):
    """All rows of the query for (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = defaultdict(list)
    for d, s, lang, n, t in rows:
        hit = d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups[lang].append((d, leaf((d, s, lang, n, t)), leaf((d, s, lang, n, t.translate(LOWER) if hit else t))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, inner, out = [], {}, []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
        sub, inner[g] = grown([r[1] for r in groups[g]])
        subs.append(sub)
    if not subs:
        return []
    root, upper = grown(subs)
    for k, g in enumerate(names):
        for (d, own, other), proof in zip(groups[g], inner[g]):
            folded = other
            for before, after in proof + upper[k]:
                folded = digest(before, folded, after)
            siblings = digest(*(b + a for b, a in proof + upper[k]))
            out.append((d, own, subs[k], root, siblings, folded, folded == root))
    return out


def found(docs):
    proved = merkle.manifest(docs, tampered={"text": merkle.tampered_text()})
    return merkle.verified(proved).select(*merkle.COLUMNS).collect()


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def some(n, langs, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice(["s", None]), rng.choice(langs), rng.choice([k, None]), rng.choice(["Aé" * k, "", None, "ab"])) for k in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (9, ["en"]), (200, ["en", "de", None, "é", ""]), (30, [f"l{k}" for k in range(20)])])
@pytest.mark.parametrize("height", [1, 4])
def test_as_by_hand(spark, by_rows, monkeypatch, n, langs, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = some(n, langs)
    assert by_rows(found(table(spark, rows))) == by_rows(by_hand(rows))


def test_more_groups_than_a_block(spark, by_rows, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    rows = [(k, "s", f"g{k:03d}", k, "A") for k in range(100)]
    assert by_rows(found(table(spark, rows))) == by_rows(by_hand(rows))


def test_odd_rows(tricky, nothing, by_rows):
    """Nulls, repeated rows and ids, empty and very long texts, clashing columns."""
    extra = {"lang": F.col("source"), "n_chars": F.length("text").cast("long"), "proof": F.lit(1), "grp": F.lit("x")}
    docs = tricky.withColumns(extra | {"leaf": F.lit(2), "root": F.lit(3), "at": F.lit(4), "part": F.lit(5)})
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert by_rows(found(docs)) == by_rows(by_hand(rows))
    assert found(nothing.withColumns(extra)) == []


def test_proof_of_a_row_that_was_not_changed_holds(spark):
    rows = some(50, ["en", "de"])
    proved = merkle.manifest(table(spark, rows))
    for r in proved.collect():
        assert r.other is None and merkle.fold(r.leaf, [(p.before, p.after) for p in r.proof]) == r.root
    assert proved.select("root").distinct().count() == 1


def test_queue_hands_on_in_the_order_of_labels():
    leaves = [digest(str(k)) for k in range(100)]
    nodes = merkle.climb(leaves, merkle.levels_for(100))
    root, proofs = grown(leaves)
    assert [len(level) for level in nodes] == [100, 13, 2, 1] and nodes[-1] == [root]
    assert merkle.descend(nodes, []) == proofs
