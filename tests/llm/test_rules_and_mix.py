"""Quality ledger, source mixing and URL templates."""

import glob
import os

import pytest
from models import copies, quality

import __spark_entry__ as entry
from compare import duckdb_rows, spark_rows
from footfall.llm import mixing, quality_rules, url_templates

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
EDGE = [
    (1, None, "en", "b", 0, "x"), (2, "", "en", None, 0, None), (3, " \t\n\x0b\r", "en", "a", 5, ""), (4, "a b c a b c", None, "a", 11, ""),
    (4, "a b c a b c", None, "a", 11, ""), (5, "word " * 3000, "en", "b", 15000, ""), (6, "x y\nx y\n\nx y\n&& <>", "en", "", 10, ""),
    (None, "größe é ü", "de", "c", 9, ""), (7, " ".join(f"w{i}" for i in range(80)), "en", "c", 1, ""),
]


@pytest.mark.parametrize("rows", [EDGE, []])
def test_ledger_is_the_model(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r) for r in quality_rules.ledger(docs).collect()), key=repr)
    assert got == sorted(((r[0], *quality(r[1])) for r in rows), key=repr)


def test_policies_filter_and_ablate(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [7]
    book = quality_rules.ledger(docs)
    bits = [quality(r[1])[-1] for r in EDGE]
    for r in quality_rules.ablations(book, "v1").collect():
        hit = [b & 7 for b in bits]
        assert r.rejected == sum(b & r.bit > 0 for b in hit)
        assert r.rejected_alone == sum(b == r.bit for b in hit)
        assert r.kept_without == sum(b & ~r.bit == 0 for b in hit)
    assert quality_rules.ablations(quality_rules.ledger(docs.limit(0))).count() == 0


@pytest.mark.parametrize("rows", [EDGE, []])
def test_mix_is_the_model(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.plan_mix(docs).collect()
    if rows:
        want, target = copies([(r[0] if r[0] is not None else "null", r[1], r[3]) for r in rows])
        for r in plan:
            assert r["__target"] == pytest.approx(target[r["__row"].source])
            assert r["__copies"] == want[r["__row"].doc_id if r["__row"].doc_id is not None else "null"]
        assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(repr(r["__row"]) for r in plan for _ in range(r["__copies"]))
    assert mixing.mix(docs).columns == docs.columns and len(plan) == len(rows)


@pytest.mark.parametrize("name", ["op7_quality_rules", "op8_mix_sources"])
def test_check_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    assert spark_rows(entry.queries()[name](spark, small)) == duckdb_rows(con, entry.oracle_sql()[name])


URLS = [
    (1, "http://A.Example.NET/en/1"), (2, "https://example.net/enx"), (3, "https://x.org/fr/a?q"), (4, "http://example.com/de/2#f"), (5, "http://notexample.com/de/2"),
    (6, None), (7, "no scheme"), (8, "http://net"), (9, "ftp://h?x/y"), (10, "a://b://c/d"), (11, "http://ÄB.net/"), (None, "http://c.org/x"), (5, "http://notexample.com/de/2"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(*r, "v") for r in URLS], "page_id long, url string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(pages).collect()}
    assert got == {
        (1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "example.net", "/enx", "net/", "block"), (3, "x.org", "/fr/a", "org/fr/", "allow"),
        (4, "example.com", "/de/2", "example.com/de/", "block"), (5, "notexample.com", "/de/2", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "net", "", None, "allow"), (9, "h", "", None, "allow"), (10, "b:", "//c/d", None, "allow"), (11, "Äb.net", "/", "net/", "block"), (None, "c.org", "/x", None, "allow"),
    }
    assert url_templates.judge(pages).count() == len(URLS)
    assert url_templates.judge(pages.limit(0)).count() == 0


def test_templates_learn_from_labels(spark):
    rows, labels = [], []
    for i in range(400):
        kind = ("ads", "offers", "news", f"user-name-{chr(97 + i % 26)}{i * 7919 % 9973}x")[i % 4]
        rows.append((i, f"http://h.example.org/{kind}/{i}.html"))
        if i % 3 == 0:
            labels.append((i, int(kind in ("ads", "offers"))))
    found = url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=())
    by = {r.page_id: r for r in found.collect()}
    assert all((by[i].verdict == "block") == (i % 4 < 2) for i in range(400))
    # Alike branches are one template, names that vary are a wildcard.
    assert by[0].template == by[1].template == "/ads|offers/{n}.html"
    assert by[2].template == by[3].template and "news" in by[2].template
