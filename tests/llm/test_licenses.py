import re

from viewloom.llm import licenses

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hits = [
        (k, label)
        for phrase, label in PHRASES.items()
        for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    places = [k for k, _ in hits]
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(hits), first, last, ",".join(sorted({x for _, x in hits}))


def test_base_equals_brute_force(tricky, pairs, by_rows):
    got = licenses.scan_licenses(tricky).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert by_rows(got.collect()) == by_rows((i, *brute(t)) for i, t in pairs)


def scan(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}


def test_notices_survive_small_changes(spark):
    whole = (
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files"
    )
    inserted = whole.replace("any person", "any lucky person")
    cut = whole.split()
    del cut[10]
    found = scan(spark, whole, "x " + inserted + " y", " ".join(cut), "permission is hereby granted to all", f"{whole} {whole}")
    assert [found[k].labels for k in range(5)] == ["mit", "mit", "mit", "", "mit"]
    assert found[0].score == 1.0 and 0.8 <= found[1].score < 1 and found[3].score == 0
    assert [(s.start, s.end) for s in found[1].spans] == [(1, len(inserted.split()) + 1)]
    assert len(found[4].spans) == 2


def test_phrases_count_at_every_place(spark):
    found = scan(spark, "all rights reserved all rights reserved", "CC-BY cc by ccby", "cc bÿ", "All rights reserved")
    assert (found[0].n_base, found[0].first_word, found[0].last_word) == (2, 0, 3)
    assert (found[1].n_base, found[1].last_word) == (2, 2)
    assert found[2].n_base == found[3].n_base == 0


def test_no_rows(nothing):
    assert licenses.scan_licenses(nothing).count() == 0


def test_plan_is_native(tricky):
    plan = licenses.scan_licenses(tricky)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan.replace("InMemoryTableScan", ""))
