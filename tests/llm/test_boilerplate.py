from viewloom.llm import boilerplate


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def brute(rows, ratio=0.1, least=5):
    hosts = {}
    for _, host, text in rows:
        if host is not None:
            hosts.setdefault(host, set()).add(text or "")
    strip = " \t\r"
    bad = {}
    for host, pages in hosts.items():
        counts = {}
        for page in pages:
            for line in {x.strip(strip) for x in page.split("\n")} - {""}:
                counts[line] = counts.get(line, 0) + 1
        bad[host] = {line for line, n in counts.items() if n >= least and n > ratio * len(pages)}
    out = []
    for i, host, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(strip) not in bad.get(host, ())]
        out.append((i, "\n".join(kept), len(lines) - len(kept)))
    return out


def site(host, n, start=0):
    return [(start + k, host, f"own {host} {k}\nMenu\n\n  Menu \r\nline {k % 4}\nend {k}") for k in range(n)]


def test_ratio_alone_decides_from_two_pages(spark, by_rows):
    """Sites of 1, 2 and 4 pages, and lines on 2 of 19 and of 21 pages."""
    rows = site("a", 1) + site("b", 2, 50) + site("c", 4, 60)
    rows += [(100 + k, "d", f"own {k}" + "\nseldom" * (k < 2)) for k in range(19)] + [(200 + k, "e", f"own {k}" + "\nseldom" * (k < 2)) for k in range(21)]
    got = boilerplate.drop_boilerplate(docs_of(spark, rows), dropped_col="n").select("doc_id", "text", "n")
    want = brute(rows, least=2)
    assert by_rows(got.collect()) == by_rows(want)
    assert {i for i, _, n in want if n} == {50, 51, 60, 61, 62, 63, 100, 101}


def test_lines_of_a_site_are_dropped(spark, by_rows):
    rows = site("a", 30) + site("b", 4, 50) + site(None, 12, 80)
    rows += [(100 + k, "c", "the same page\nfooter") for k in range(20)] + [(130 + k, "c", f"page {k}") for k in range(20)]
    rows += [(200, "a", None), (201, "a", ""), (202, "a", "Menu")]
    got = boilerplate.drop_boilerplate(docs_of(spark, rows), dropped_col="n", min_pages=5).select("doc_id", "text", "n")
    want = brute(rows)
    assert by_rows(got.collect()) == by_rows(want)
    assert {i for i, _, n in want if n} == {*range(30), 202}  # neither copies nor small sites nor rows without a site


def test_many_lists_are_joined_without_a_broadcast(spark, monkeypatch, by_rows):
    monkeypatch.setattr(boilerplate, "BROADCAST_LINES", 0)
    rows = site("a", 30) + site("b", 40, 50)
    got = boilerplate.drop_boilerplate(docs_of(spark, rows), dropped_col="n").select("doc_id", "text", "n")
    assert by_rows(got.collect()) == by_rows(brute(rows))


def test_other_rows_and_columns_stay(tricky, nothing, pairs, by_rows):
    done = boilerplate.drop_boilerplate(tricky)
    assert done.columns == tricky.columns
    assert by_rows(done.select("doc_id", "text").collect()) == by_rows((i, t or "") for i, t in pairs)
    assert boilerplate.drop_boilerplate(nothing).count() == 0
