"""Decisions on URLs: rules, references, aliases."""

import shutil

import pytest
from pyspark.sql import functions as F

from tenderlake.llm import url_filters as U
from tenderlake.llm.queries_urls import ORACLE, RULES, op12_url_filters

from ..oracle import DATA, TABLES, same

CANONICAL = '<html><head><link rel="canonical" href="{}"></head></html>'


def rules(spark, rows=RULES):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def verdicts(spark, rows, redirects=None, of=RULES):
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, host string, node string, verdict string")
    found = U.judged(pages, rules(spark, of), redirects).collect()
    assert len(found) == len(rows)
    return {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}


def test_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q#f", None), (2, "http://a.example.net/de/", None), (3, "https://net/", None), (4, "http://a.net", None), (5, "http://a.net?x=/", None),
        (6, "http://example.com/de/1", None), (7, "http://badexample.com/de/1", None), (8, "ftp://w.org/fr/", None), (9, None, None), (10, "", ""), (11, "no scheme.net/", ""),
        (12, "x://y.net/://org/fr/", ""), (None, "http://b.net/", None), (13, "http://exämple.net/EN/", ""), (14, "://net/", ""),
    ]
    got = verdicts(spark, rows)
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("a.example.net", "/de/", "net/", "block")
    assert got[3] == ("net", "/", "net/", "block") and got[4] == ("a.net", "", None, "allow") and got[5] == ("a.net", "", None, "allow")
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == (None, "allow") and got[8][2:] == ("org/fr/", "allow")
    assert got[9] == got[10] == got[11] == ("", "", None, "allow") and got[12][:3] == ("y.net", "/://org/fr/", "net/") and got[None][3] == "block"
    assert got[13][0] == "exämple.net" and got[13][3] == "block" and got[14][:2] == ("net", "/")


def test_longest_rule_and_ties(spark):
    of = [("b.c", "/ab", "block"), ("a.b.c", "/", "block"), ("a.b.c", "/", "allow"), ("c", "", "block"), (None, "/", "block"), ("d", None, "block")]
    got = verdicts(spark, [(1, "http://a.b.c/ab", None), (2, "http://b.c/ab", None), (3, "http://x.c/", None), (4, "http://d/", None)], of=of)
    assert [got[k][2:] for k in (1, 2, 3, 4)] == [("a.b.c/", "allow"), ("b.c/ab", "block"), ("c", "block"), (None, "allow")]
    assert verdicts(spark, [(1, "http://a.net/", None)], of=[("zz", "/", "block")])[1][3] == "allow"
    assert U.judged(spark.createDataFrame([(1, "http://a.net/", None)], "page_id long, url string, html string"), rules(spark, RULES).limit(0)).first()["verdict"] == "allow"


@pytest.mark.parametrize(
    "reference,url",
    [
        ("http://x.y/a", "http://x.y/a"), ("//x.y/a", "http://x.y/a"), ("/a?b", "http://h.k/a?b"), ("?z=1", "http://h.k/p/q?z=1"), ("r/s", "http://h.k/p/r/s"), ("../r", "http://h.k/r"),
        ("./r/../t/..", "http://h.k/p/"), ("#top", None), ("", None), ("mailto:a@b.c", None), ("javascript:void(0)", None), ("HTTPS://X.y/", "HTTPS://X.y/"), ("../../../r?x=../y", "http://h.k/r?x=../y"),
    ],
)
def test_references(spark, reference, url):
    df = spark.createDataFrame([("https://H.k/p/q?z#w", reference)], "base string, reference string")
    assert df.select(U.resolved(F.col("base"), F.col("reference"))).first()[0] == url


def test_page_targets(spark):
    pages = [
        ('<link rel="canonical" href="http://x.y/1">', ["http://x.y/1"]), ("<LINK HREF='/1?a=1&amp;b=2' REL='alternate canonical'>", ["http://h.k/1?a=1&b=2"]), ("<link rel=canonical href=/2>", ["http://h.k/2"]),
        ('<link rel="noncanonical" href="/1">', []), ('<!-- <link rel="canonical" href="/1"> -->', []), ("<script>'<link rel=\"canonical\" href=\"/1\">'</script>", []), ('<link rel="canonical">', []),
        ('<link rel="stylesheet" href="/canonical.css"><link rel="canonical" href="/3"><link rel="canonical" href="/4">', ["http://h.k/3"]),
        ('<meta http-equiv="refresh" content="0; url=\'/5\'">', ["http://h.k/5"]), ('<meta http-equiv=Refresh content="3;URL=http://x.y/6">', ["http://x.y/6"]), ('<meta http-equiv="refresh" content="30">', []), ('<meta name="x" content="0;url=/7"> refresh', []), (None, []), ("", []),
    ]
    df = spark.createDataFrame([(i, "http://h.k/p/q", h) for i, (h, _) in enumerate(pages)], "i int, url string, html string")
    got = {r[0]: r[1] for r in df.select("i", U.page_targets(F.col("html"), F.col("url"))).collect()}
    assert [got[i] for i in range(len(pages))] == [t for _, t in pages]


def alias_rows():
    return [
        (1, "http://one.test/a", CANONICAL.format("http://two.test/b")), (2, "https://two.test/b#x", CANONICAL.format("http://bad.net/c")), (3, "http://three.test/", CANONICAL.format("/d")), (4, "http://three.test/d", '<meta http-equiv="refresh" content="0; url=http://one.test/a">'),
        (5, "http://www.example.net/en/5", CANONICAL.format("http://bad.net/c")), (6, "http://six.test/", CANONICAL.format("http://q.org/fr/1")), (7, "http://seven.test/", CANONICAL.format("http://six.test/")), (8, "http://worse.net/", CANONICAL.format("http://six.test/")),
        (9, "http://nine.test/x/../y", CANONICAL.format("../z/./w")), (10, "http://nine.test/z/w", CANONICAL.format("http://bad.net/e?f")), (11, "http://other.test/", CANONICAL.format("http://other.test/")), (12, None, CANONICAL.format("http://bad.net/c")), (13, "http://two.test/b?q", None),
        (14, "http://one.test/a", None), (14, "http://one.test/a", None), (15, "http://a.net/ax", CANONICAL.format("mailto:x")),
    ]


def test_aliases(spark):
    """Without an allow in their component, aliases of a blocked URL are blocked; a page's own rule stands."""
    rows = alias_rows()[:4] + alias_rows()[5:]
    pages = [r for r in rows if r[0] != 14]
    got = {k: v[3] for k, v in verdicts(spark, pages).items()}
    assert [got[k] for k in (1, 2, 3, 4)] == ["block"] * 4
    assert [got[k] for k in (6, 7, 8)] == ["allow", "allow", "block"] and [got[k] for k in (9, 10, 11, 12, 13)] == ["block", "block", "allow", "allow", "allow"]
    with_allow = {k: v[3] for k, v in verdicts(spark, [r for r in alias_rows() if r[0] != 14]).items()}
    assert [with_allow[k] for k in (1, 2, 3, 4, 5)] == ["allow"] * 5


def test_redirects(spark):
    """A chain of redirects, none of whose middle URLs is a page, in a table of its own; many aliases of one URL."""
    chain = [(f"http://hop.test/{i}", f"/{i + 1}") for i in range(30)] + [("http://hop.test/30", "http://end.net/"), (None, "http://a.b/"), ("http://a.b/", None)]
    hub = [(f"http://spoke{i}.test/", "http://hop.test/7") for i in range(200)]
    redirects = spark.createDataFrame(chain + hub, "source string, target string")
    rows = [(1, "http://hop.test/0", None), (2, "http://hop.test/30", ""), (3, "http://a.b/", None)] + [(10 + i, f"http://spoke{i}.test/", None) for i in range(200)]
    got = verdicts(spark, rows, redirects)
    assert got[1][3] == got[2][3] == "block" and got[3][3] == "allow" and all(got[10 + i][3] == "block" for i in range(200))


def test_query_against_sql_with_aliases(spark, tmp_path):
    for t in TABLES:
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path)
    shutil.rmtree(tmp_path / "pages.parquet", ignore_errors=True)
    (tmp_path / "pages.parquet").unlink(missing_ok=True)
    rows = spark.createDataFrame(alias_rows(), "page_id long, url string, html string").toPandas()
    rows.to_parquet(tmp_path / "pages.parquet", index=False)
    same(spark, op12_url_filters, ORACLE["op12_url_filters"], str(tmp_path))
