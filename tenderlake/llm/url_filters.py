"""URL filters whose decisions hold for all aliases of a page.

Rules name a host and the start of a path. Redirects and canonical links
connect URLs; the connected components of these links are computed by Spark,
and a decision on one URL of a component holds for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, let, materialise, small_side
from .components import components

#: Fixed values. Tags that name another URL of the same page, and their attributes.
LINK_TAG = "(?i)<link\\s[^>]*>"
META_TAG = "(?i)<meta\\s[^>]*>"
CANONICAL = "(?i)\\srel\\s*=\\s*(\"([^\"]*\\s)?canonical(\\s[^\"]*)?\"|'([^']*\\s)?canonical(\\s[^']*)?'|canonical[\\s/>])"
REFRESH = "(?i)\\shttp-equiv\\s*=\\s*[\"']?refresh[\"'\\s/>]"
HREF = "(?i)\\shref\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
CONTENT = "(?i)\\scontent\\s*=\\s*(\"[^\"]*\"|'[^']*')"
REFRESH_URL = "(?i)^\\s*[0-9.]+\\s*[;,]\\s*url\\s*=\\s*[\"']?([^\"']+)"
#: Fixed value. What is no tag of the page: comments and scripts.
HIDDEN = "(?is)<!--.*?-->|<script.*?</script>"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    return F.coalesce(F.when(url.contains("://"), url.substr(F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def alias_key(url: Column) -> Column:
    """What two forms of one URL share: host, path and query, without scheme and fragment; null if there is no host."""
    query = F.regexp_extract(_after_scheme(url), "^[^?#]*(\\?[^#]*)", 1)
    return F.when(url_host(url) != "", F.concat(url_host(url), url_path(url), query))


def resolved(base: Column, reference: Column) -> Column:
    """``reference`` as a URL, seen from the page at ``base``; null if it names no web page.

    Absolute, ``//host``, ``/path``, ``?query`` and relative references are
    resolved, with ``.`` and ``..`` in their paths; others (``mailto:``,
    fragments, empty ones) are null.
    """
    ref = F.trim(reference)
    site = F.concat(F.lit("http://"), url_host(base))
    folder = F.regexp_extract(url_path(base), "^(.*/)[^/]*$", 1)
    place = (
        F.when(ref.rlike("(?i)^https?://"), ref)
        .when(ref.rlike("^(#|$)") | ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(ref.startswith("//"), F.concat(F.lit("http:"), ref))
        .when(url_host(base) == "", None)
        .when(ref.startswith("/"), F.concat(site, ref))
        .when(ref.startswith("?"), F.concat(site, url_path(base), ref))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), ref))
    )

    def walked(url: Column) -> Column:
        steps = F.split(url_path(url), "/")
        last = F.element_at(steps, -1)
        path = F.aggregate(
            F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))),
            F.lit(""),
            lambda done, step: F.when(step == "..", F.regexp_replace(done, "/[^/]*$", "")).when(step == ".", done).otherwise(F.concat(done, F.lit("/"), step)),
        )
        path = F.concat(path, F.when(last.isin(".", ".."), "/").otherwise(""))
        query = F.regexp_extract(url, "^[^?#]*(\\?[^#]*)", 1)
        return F.when(url_path(url).rlike("/\\.\\.?(/|$)"), F.concat(F.lit("http://"), url_host(url), path, query)).otherwise(url)

    return let(place, walked)


def page_targets(html: Column, url: Column) -> Column:
    """The URLs that a page gives for itself: its first canonical link and its first refresh, as an array without nulls.

    Tags in comments and scripts don't count. Null pages give none.
    """

    def value(tag: Column, pattern: str) -> Column:
        return F.replace(F.regexp_replace(F.regexp_extract(tag, pattern, 1), "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&"))

    def found(text: Column) -> Column:
        links = F.filter(F.regexp_extract_all(text, F.lit(LINK_TAG), F.lit(0)), lambda t: t.rlike(CANONICAL) & t.rlike(HREF))
        metas = F.filter(F.regexp_extract_all(text, F.lit(META_TAG), F.lit(0)), lambda t: t.rlike(REFRESH))
        links = F.transform(F.slice(links, 1, 1), lambda t: value(t, HREF))
        metas = F.transform(F.slice(metas, 1, 1), lambda t: F.regexp_extract(value(t, CONTENT), REFRESH_URL, 1))
        return F.concat(links, metas)

    lower = F.lower(html)
    some = lower.contains("canonical") | lower.contains("refresh")
    references = F.when(some, let(F.regexp_replace(html, HIDDEN, " "), found)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(references, lambda r: resolved(url, r)), lambda u: u.isNotNull())


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of those rows of ``urls(host, path)`` that a rule fits, with the longest such rule.

    A rule of ``rules(host, path, verdict)`` fits its host and all subdomains,
    if the path starts with the rule's. Of rules of equal length that with
    the longer host wins, and of equal ones an allow. Rules with nulls fit
    nothing. ``urls`` are distinct; they meet the rules in an equality join of
    the ends of their hosts and the starts of their paths, in the lengths that
    the rules have, so the number of rules doesn't matter.
    """
    rules = materialise(rules.select("host", "path", "verdict").filter("host != '' AND path IS NOT NULL AND verdict IS NOT NULL").distinct(), "rules")
    shape = rules.agg(F.max(F.size(F.split("host", "\\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    kinds = "host string, path string, rule string, verdict string"
    if not shape["labels"]:
        return urls.sparkSession.createDataFrame([], kinds)
    labels = F.split("host", "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"]))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    lengths = F.filter(F.array(*map(F.lit, shape["lengths"])), lambda k: k <= F.length("path"))
    tried = urls.select("host", "path", F.explode(ends).alias("rule_host"), lengths.alias("lengths")).select(
        "host", "path", "rule_host", F.explode(F.transform("lengths", lambda k: F.col("path").substr(F.lit(1), k))).alias("rule_path")
    )
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    fits = tried.join(small_side(named), ["rule_host", "rule_path"])
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), (F.col("verdict") == "allow").cast("int"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def alias_links(pages: DataFrame, url_col: str, html_col: str | None, redirects: DataFrame | None) -> DataFrame:
    """Links ``u, v`` between alias keys: canonical links and refreshes of the pages, and ``redirects(source, target)``."""
    links = pages.sparkSession.createDataFrame([], "u string, v string")
    if html_col:
        own = pages.select(F.col(url_col).cast("string").alias("page_url"), F.col(html_col).cast("string").alias("page_html"))
        targets = own.select("page_url", page_targets(F.col("page_html"), F.col("page_url")).alias("targets")).select(F.col("page_url").alias("url"), F.explode("targets").alias("target"))
        links = targets.select(alias_key(F.col("url")).alias("u"), alias_key(F.col("target")).alias("v"))
    if redirects is not None:
        links = links.union(redirects.select(alias_key(F.col("source")), alias_key(resolved(F.col("source"), F.col("target")))))
    return links.filter("u != v").distinct()


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``id, host, path, rule, verdict`` of every row of ``pages``.

    A page whose own URL a rule fits has that rule's verdict, whatever its
    aliases are. Another page whose component holds a URL that a rule allows
    is allowed; otherwise it is blocked if its component holds a URL that a
    rule blocks, and allowed if there is none. URLs that are only the target
    of a link take part. Rows with null, empty or repeated ids, URLs and pages
    stay one row each; a null URL has empty host and path and no alias.
    """
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select(
        "id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), alias_key(F.col("url")).alias("node")
    )
    nodes = components(alias_links(pages, url_col, html_col, redirects))
    nodes = materialise(nodes.select("node", "root", F.regexp_extract("node", "^[^/?#]*", 0).alias("host"), F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1).alias("path")), "aliases")
    urls = named.select("host", "path").union(nodes.select("host", "path")).filter("host != ''").distinct()
    found = materialise(fitting_rules(urls, rules), "fitting-rules")
    by_root = nodes.join(small_side(found), ["host", "path"]).groupBy("root").agg(F.max(F.when(F.col("verdict") == "allow", 2).otherwise(1)).alias("strongest"))
    aliases = materialise(nodes.join(by_root, "root").select("node", F.when(F.col("strongest") == 2, "allow").otherwise("block").alias("of_aliases")), "alias-verdicts")
    out = named.join(small_side(found), ["host", "path"], "left").join(small_side(aliases), "node", "left")
    return out.select("id", "host", "path", "rule", F.coalesce("verdict", "of_aliases", F.lit("allow")).alias("verdict"))
