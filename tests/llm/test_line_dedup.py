import re
from collections import defaultdict

import pytest

import corpus_pipeline
from tileframe.llm import line_dedup


def plain(rows, min_sites):
    sites = defaultdict(set)
    for _, source, text in rows:
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line) and source is not None:
                sites[line].add(source)
    gone = {line for line, s in sites.items() if len(s) >= min_sites}
    out = []
    for i, source, text in rows:
        lines = (text or "").split("\n")
        out.append((str(i), str(source), None if text is None else "\n".join(x for x in lines if x not in gone), sum(x in gone for x in lines)))
    return sorted(out, key=str)


def got(docs, min_sites):
    rows = line_dedup.drop_boilerplate(docs, min_sites).select("doc_id", "source", "text", "n_removed").collect()
    return sorted(((str(r.doc_id), str(r.source), r.text, r.n_removed) for r in rows), key=str)


@pytest.mark.parametrize("limit", [1_000_000, -1])
@pytest.mark.parametrize("min_sites", [2, 10])
@pytest.mark.parametrize("name", ["documents", "odd_docs"])
def test_whole_tables(request, monkeypatch, name, min_sites, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    docs = request.getfixturevalue(name)
    assert got(docs, min_sites) == plain([tuple(r) for r in docs.select("doc_id", "source", "text").collect()], min_sites)


def test_many_sites_near_the_threshold(spark):
    """Lines on 80 to 120 sites, with a threshold of 100: exact counts settle what the sketches can't."""
    rows = [(n * 1000 + k, f"site{k}", f"line {n}\nown {n} {k}") for n in range(80, 121) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    assert got(docs, 100) == plain(rows, 100)


def test_very_long_texts(spark):
    rows = [(k, f"site{k % 12}", "\n".join(f"line {i} of {k if i % 2 else 'all'}" for i in range(20_000))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert got(docs, 10) == plain(rows, 10)


def test_other_columns_stay(odd_docs):
    assert sorted(line_dedup.drop_boilerplate(odd_docs).columns) == sorted([*odd_docs.columns, "n_removed"])
    assert line_dedup.drop_boilerplate(odd_docs, 2).where("_gone != 'clash' or _key != 'clash' or row_key != 'clash' or gone_places != 'clash'").count() == 0
    assert line_dedup.drop_boilerplate(odd_docs.limit(0)).count() == 0


def test_copied_texts_keep_their_lines(spark, sf):
    """One text on 20 sites, near copies of another on 20, and a footer on 20 sites below texts of their own: only the footer goes."""
    own = lambda k: "\n".join(f"own line {n} of text {k}" for n in range(9))
    near = lambda k: "\n".join(f"changed by site {k}" if n == k % 9 else f"line {n} of many near copies" for n in range(9))
    texts = [t for k in range(20) for t in (own("copied"), near(k), f"{own(k)}\nthe footer", f"{own('copied')}\nthe footer")]
    docs = spark.createDataFrame([(i, t, "en", f"site{i // 4}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, sf).collect()}
    assert kept == {i: t.removesuffix("\nthe footer") for i, t in enumerate(texts)}


def test_spared_copies_of_odd_rows(odd_docs):
    assert line_dedup.drop_boilerplate(odd_docs, 2, spare_copies=True).count() == odd_docs.count()


def menus(share, sites=60, own=8):
    """Pages of ``sites`` sites with ``own`` lines each and so many shared menu lines that these are the given share of a page."""
    n = round(own * share / (1 - share))
    return [(k, "\n".join([f"menu entry {i:03d} of all sites" for i in range(n)] + [f"own words {k:03d} of line {i:02d}" for i in range(own)])) for k in range(sites)], n


@pytest.mark.parametrize("share", [0.2, 0.4, 0.6, 0.75])
def test_menus_of_pages_that_are_mostly_menu_go(spark, sf, share):
    pages, n = menus(share)
    docs = spark.createDataFrame([(k, t, "en", f"site{k}", len(t)) for k, t in pages], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, sf).collect()}
    assert kept == {k: "\n".join(t.split("\n")[n:]) for k, t in pages}


def test_a_text_of_very_many_lines_that_go(spark):
    """100,000 lines in the text, half of them boilerplate: no line is looked for among all that go."""
    rows = [(k, f"site{k}", "\n".join(f"line {i} of {k if i % 2 else 'all'}" for i in range(100_000 if k == 0 else 20))) for k in range(11)]
    rows += [(100 + k, f"site{k}", "\n".join(f"line {i} of all" for i in range(0, 100_000, 2))) for k in range(1, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert got(docs, 10) == plain(rows, 10)
