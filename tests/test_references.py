"""Queries without SQL against plain Python over the same tables."""

import re
from urllib.parse import unquote

from tenderlake.plans import registry

from .oracle import DATA


def texts(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def java_trim(s):
    """Spark's trim takes spaces only."""
    return s.strip(" ")


def test_sentences(spark):
    got = sorted((r["doc_id"], r["pos"], r["sentence"]) for r in registry.QUERIES["t12_sentences"](spark, DATA).collect())
    expect = []
    for name, text in texts(spark):
        parts = [java_trim(s) for s in re.split(r"\n+|(?<=[.!?])[ \t\n\x0b\f\r]+|•", text)]
        expect += [(name, i, s) for i, s in enumerate(s for s in parts if s)]
    assert got == sorted(expect)


def test_unwrapped_lines(spark):
    opens = re.compile(r"([0-9]+[.)]|[-*•]|[A-Z][A-Za-z ]{1,30}:)")
    got = sorted((r["doc_id"], r["pos"], r["line"]) for r in registry.QUERIES["e6_unwrapped_lines"](spark, DATA).collect())
    expect = []
    for name, text in texts(spark):
        done, current = [], None
        for line in map(java_trim, text.split("\n")):
            if not line:
                done, current = done + ([current] if current else []), None
            elif current and not opens.match(line) and current[-1] not in ".:;!?":
                current += " " + line
            else:
                done, current = done + ([current] if current else []), line
        expect += [(name, i, s) for i, s in enumerate(done + ([current] if current else []))]
    assert got == sorted(expect)


def test_attachment_names(spark):
    got = sorted((r["page"], r["filename"], r["url_name"], r["url"]) for r in registry.QUERIES["s7_attachment_names"](spark, DATA).collect())
    expect = []
    for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").collect():
        html = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", r["html"] or "")
        seen = set()
        for href, inside in re.findall(r'(?s)<a\s[^>]*?href="(/[^"]*)"[^>]*>(.*?)</a>', html):
            if href in seen:
                continue
            seen.add(href)
            text = " ".join(re.sub("<[^>]*>", "", inside).split())
            name = unquote(re.split("[?#]", href)[0].split("/")[-1])
            expect.append((r["page_id"], text or name, name, "https://example.org/" + href.lstrip("/")))
    assert len(got) > 100 and got == sorted(expect)
