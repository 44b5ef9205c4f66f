"""HTML pages to rows: links, tables, label-value pairs and the notices made of them.

One Arrow-batched job reads the pages, as rows of their cells (``cells``), of
their table rows (``table_rows``) or whole (``whole_pages``); everything after it is made of DataFrame
operations on its rows. What a page alone decides is an expression over its
own rows, so that pages are read once and not shuffled again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import bind

CELL = "kind string, tbl int, tr int, col int, is_header boolean, text string, href string"


#: What tags do: contents left out, a text before them ended, and their own part.
_SKIP, _BREAK, _TABLE, _ROW, _CELL, _LINK = 1, 2, 4, 8, 16, 32
_TAGS = {
    **dict.fromkeys(("script", "style", "title"), _SKIP),
    **dict.fromkeys("p div br li h1 h2 h3 h4 dt dd b strong label span".split(), _BREAK),
    "table": _TABLE, "tr": _BREAK | _ROW, "td": _BREAK | _CELL, "th": _BREAK | _CELL, "a": _LINK,
}


class _Tokens(HTMLParser):
    """The tags and texts of any page, however broken, as ``_rows_of`` takes them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found.append(("", tag, attrs, ""))

    def handle_endtag(self, tag: str) -> None:
        self.found.append(("/", tag, None, ""))

    def handle_data(self, data: str) -> None:
        if data:
            self.found.append(("", "", None, data))


#: A page of plain tags and texts: nothing escaped, cut off or read in another way; and its tokens.
_PLAIN = re.compile(r"""(?:[^<&]+|<[A-Za-z][A-Za-z0-9]*(?:[ \t\n\r\f]+[A-Za-z][A-Za-z0-9-]*(?:="[^"<>&]*")?)*+[ \t\n\r\f]*>|</[A-Za-z][A-Za-z0-9]*>)*+""")
_TOKEN = re.compile("<(/?)([A-Za-z0-9]+)([^>]*)>|([^<]+)")
_ATTRIBUTE = re.compile("""([A-Za-z][A-Za-z0-9-]*)(?:="([^"]*)")?""")
#: Elements whose contents aren't markup.
_RAW = re.compile(r"(?i)<(?:script|style|title|textarea|xmp|iframe|noembed|noframes|plaintext|noscript)")


def _read(html: str) -> list[tuple]:
    """The rows of a page. Plain pages are split into tokens at once; any others go through the parser."""
    if _PLAIN.fullmatch(html) and not _RAW.search(html):
        return _rows_of(_TOKEN.findall(html))
    page = _Tokens()
    page.feed(html)
    page.close()
    return _rows_of(page.found)


def _flat(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _href(attrs: str | list) -> str | None:
    """The last ``href`` of a tag, from its text or its parsed attributes."""
    return dict([(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if isinstance(attrs, str) else attrs).get("href")


def _rows_of(tokens: list[tuple]) -> list[tuple]:
    """Links, cells and loose texts, in document order, of tokens ``(slash, tag, attributes, text)``; broken markup gives what there is."""
    rows: list[tuple] = []
    add, kind_of = rows.append, _TAGS.get
    skip, tbl, tr, col = 0, -1, -1, -1
    cell = link = href = None
    header = False
    loose: list[str] = []
    for closing, tag, attrs, data in tokens:
        if data:
            if not skip:
                if cell is not None:
                    cell.append(data)
                elif link is None:
                    loose.append(data)
                if link is not None:
                    link.append(data)
            continue
        kind = kind_of(tag) or kind_of(tag.lower(), 0)
        if not kind:
            continue
        if loose and kind & _BREAK:
            if text := _flat(loose):
                add(("text", None, None, None, None, text, None))
            loose = []
        if cell is not None and kind & (_ROW | _CELL):
            add(("cell", tbl, tr, col, header, _flat(cell), None))
            cell = None
        if kind & _CELL:
            if not closing:
                col += 1
                header, cell = tag in ("th", "TH", "tH", "Th"), []
        elif kind & _ROW:
            if not closing:
                tr, col = tr + 1, -1
        elif kind == _LINK:
            new = None if closing else _href(attrs)
            if link is not None and (closing or new):
                add(("link", *((tbl, tr, col) if tr >= 0 else (None, None, None)), None, _flat(link), href))
                link = None
            if new:
                href, link = new, []
        elif kind == _TABLE:
            tbl, tr = tbl + (not closing), -1
        elif kind == _SKIP:
            skip = max(0, skip - 1) if closing else skip + 1
    if text := _flat(loose):
        add(("text", None, None, None, None, text, None))
    if cell is not None:
        add(("cell", tbl, tr, col, header, _flat(cell), None))
    if link is not None:
        add(("link", *((tbl, tr, col) if tr >= 0 else (None, None, None)), None, _flat(link), href))
    return rows


#: Rows and characters that a worker holds before it hands them on, so that its memory doesn't follow the number of pages.
HELD_ROWS, HELD_CHARS = 20_000, 8_000_000


def _page_rows(pages: DataFrame, id_col: str, html_col: str, schema: str, rows_of: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """``page`` and the columns of ``schema``: what ``rows_of`` makes of the rows of each page."""
    kind = pages.schema[id_col].dataType.simpleString()
    fields = list(to_arrow_schema(StructType.fromDDL(schema)))
    names = ["page", *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            held: list[tuple] = []
            chars = 0
            ready = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array([r[i] for r in held], f.type) for i, f in enumerate(fields))], names)  # noqa: E731, B023
            for i, html in enumerate(batch.column(1)):
                html = html.as_py() or ""
                found = rows_of(_read(html))
                chars += len(html)
                for start in range(0, len(found), HELD_ROWS):
                    some = found[start : start + HELD_ROWS]
                    at += [i] * len(some)
                    held += some
                    if len(held) >= HELD_ROWS or chars >= HELD_CHARS:
                        yield ready()
                        at, held, chars = [], [], 0
            if held:
                yield ready()

    rows = pages.select(F.col(id_col).alias("page"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page {kind}, {schema}")


def cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page, pos, kind (text, cell, link), tbl, tr, col, is_header, text, href`` of every page.

    White space is collapsed; scripts and styles are left out. Null pages
    have no rows.
    """
    return _page_rows(pages, id_col, html_col, f"pos int, {CELL}", lambda rows: [(n, *row) for n, row in enumerate(rows)])


def whole_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page, rows``: the ``cells`` of a page in one row, in order, for what a page decides by itself."""
    whole = lambda rows: [([(n, kind, tbl, tr, col, text, href) for n, (kind, tbl, tr, col, _, text, href) in enumerate(rows)],)] if rows else []
    return _page_rows(pages, id_col, html_col, "rows array<struct<pos:int,kind:string,tbl:int,tr:int,col:int,text:string,href:string>>", whole)


def table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page, tbl, tr, head, cells, links``: a row per table row, with the cells of the table's first row as its ``head``."""
    return _page_rows(pages, id_col, html_col, "tbl int, tr int, head array<struct<col:int,text:string>>, cells array<struct<col:int,text:string>>, links array<struct<pos:int,href:string>>", _lines)


def _lines(rows: list[tuple]) -> list[tuple]:
    lines: dict[tuple, tuple[list, list]] = {}
    for pos, (kind, tbl, tr, col, _, text, href) in enumerate(rows):
        if kind == "cell":
            lines.setdefault((tbl, tr), ([], []))[0].append((col, text))
        elif kind == "link" and tr is not None:
            lines.setdefault((tbl, tr), ([], []))[1].append((pos, href))
    heads = {tbl: sorted(found) for (tbl, tr), (found, _) in lines.items() if tr == 0}
    return [(tbl, tr, heads.get(tbl), found, links) for (tbl, tr), (found, links) in lines.items()]


def _as_pages(rows: DataFrame) -> DataFrame:
    """``whole_pages`` from ``cells``, or as they are."""
    if "rows" in rows.columns:
        return rows
    return rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "tbl", "tr", "col", "text", "href"))).alias("rows"))


def _as_table_rows(rows: DataFrame) -> DataFrame:
    """``table_rows`` from ``cells``, or as they are."""
    if "head" in rows.columns:
        return rows
    is_cell, is_link = F.col("kind") == "cell", (F.col("kind") == "link") & F.col("tr").isNotNull()
    lines = rows.filter(is_cell | is_link).groupBy("page", "tbl", "tr").agg(
        F.sort_array(F.collect_list(F.when(is_cell, F.struct("col", "text")))).alias("cells"), F.sort_array(F.collect_list(F.when(is_link, F.struct("pos", "href")))).alias("links")
    )
    return lines.withColumn("head", F.max(F.when(F.col("tr") == 0, F.col("cells"))).over(Window.partitionBy("page", "tbl")))


def _text_at(col: Column) -> Column:
    """The text of a table row in a column, the greatest of several; null if there is none."""
    return F.array_max(F.transform(F.filter("cells", lambda x: x["col"] == col), lambda x: x["text"]))


def listing_rows(rows: DataFrame, detail_link: str, columns: list[str]) -> DataFrame:
    """A row per table row with a detail link: ``page, position, reference, url`` and its cells by ``columns``.

    ``rows`` are ``table_rows`` or ``cells``. Group 1 of ``detail_link`` is
    the reference. Table rows without such a link give nothing.
    """
    lines = _as_table_rows(rows).withColumn("__link", F.get(F.filter("links", lambda x: x["href"].rlike(detail_link)), F.lit(0)))
    found = lines.filter(F.col("__link").isNotNull() & (F.size("cells") > 0))
    url = F.col("__link.href")
    return found.select("page", F.col("__link.pos").alias("position"), F.regexp_extract(url, detail_link, 1).alias("reference"), url.alias("url"), *(_text_at(F.lit(i)).alias(c) for i, c in enumerate(columns)))


def page_links(cell_rows: DataFrame, pattern: str, exclude: str | None = None) -> DataFrame:
    """Links that match, in order: ``page, pos, href, text, n`` with n counting repeats of a link on its page."""
    kept = cell_rows.filter((F.col("kind") == "link") & F.col("href").rlike(pattern))
    kept = kept.filter(~F.col("href").rlike(exclude)) if exclude else kept
    return kept.select("page", "pos", "href", "text", F.row_number().over(Window.partitionBy("page", "href").orderBy("pos")).alias("n"))


def open_list(rows: DataFrame, id_pattern: str, next_pattern: str, failure: str, exclude: str | None = None) -> DataFrame:
    """Per page its ids in order, repeated ids apart, whether there is a next page and whether the site failed.

    ``rows`` are ``whole_pages`` or ``cells``.
    """
    wanted = lambda x: (x["kind"] == "link") & x["href"].rlike(id_pattern) & (~x["href"].rlike(exclude) if exclude else F.lit(True))
    found = F.transform(F.filter("rows", wanted), lambda x: F.struct(F.regexp_extract(x["href"], id_pattern, 1).alias("id"), x["pos"].alias("pos")))
    same = lambda x, y: F.coalesce(x["id"] == y["id"], F.lit(False))
    placed = lambda x: F.struct(x["pos"].alias("pos"), x["id"].alias("id"))

    def ids(again: bool) -> Column:
        """Sorted by id and place, an id is repeated where the one before it is the same."""
        kept = bind(F.sort_array(F.col("__found")), lambda s: F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) == F.lit(again), placed(x))))
        return F.transform(F.sort_array(F.filter(kept, lambda x: x.isNotNull())), lambda x: x["id"])

    said = lambda pattern, *names: F.exists("rows", lambda x: reduce(or_, (F.coalesce(x[n].rlike(pattern), F.lit(False)) for n in names)))
    flags = (said(next_pattern, "href", "text").alias("has_next"), said(failure, "text").alias("failed"))
    return _as_pages(rows).withColumn("__found", found).select("page", ids(False).alias("ids"), ids(True).alias("duplicates"), *flags)


def attachment_links(cell_rows: DataFrame, pattern: str, base: Column) -> DataFrame:
    """Document links: ``page, pos, filename, link_text, url_name, url`` with absolute urls."""
    links = page_links(cell_rows, pattern).filter("n = 1")
    absolute = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace("href", "^/+", "")))
    name = F.try_url_decode(F.regexp_extract("href", r"([^/?#]*)([?#].*)?$", 1))
    return links.select("page", "pos", F.coalesce(F.nullif(F.trim("text"), F.lit("")), name).alias("filename"), F.col("text").alias("link_text"), name.alias("url_name"), absolute.alias("url"))


def _labels(longest: int) -> Column:
    """``pos, label, value`` of a whole page, in one array."""
    split = r"^([^:]{1,80}):\s*(.*)$"
    said = lambda pos, label, value: F.struct(pos.alias("pos"), F.trim(label).alias("label"), value.alias("value"))
    part = lambda x, i: F.regexp_extract(x["text"], split, i)
    inline = bind(
        F.filter("rows", lambda x: x["kind"] == "text"),
        lambda t: F.transform(t, lambda x, i: F.when(x["text"].rlike(split), said(x["pos"], part(x, 1), F.coalesce(F.nullif(F.trim(part(x, 2)), F.lit("")), F.get(t, i + 1)["text"])))),
    )
    same = lambda x, y: F.coalesce((x["tbl"] == y["tbl"]) & (x["tr"] == y["tr"]), F.lit(False))
    at = lambda i, x, y: F.greatest(F.when(x["col"] == i, x["text"]), F.when(y["col"] == i, y["text"]))

    def pair(x: Column, y: Column) -> Column:
        return F.when(F.length(at(0, x, y)) <= longest, said(F.least(x["pos"], y["pos"]), F.regexp_replace(at(0, x, y), "[:/]+$", ""), at(1, x, y)))

    cell = lambda x: F.struct(*(x[n].alias(n) for n in ("tbl", "tr", "pos", "col", "text")))
    pairs = bind(
        F.sort_array(F.transform(F.filter("rows", lambda x: x["kind"] == "cell"), cell)),
        lambda c: F.transform(c, lambda x, i: F.when(same(x, F.get(c, i + 1)) & ~same(x, F.get(c, i - 1)) & ~same(x, F.get(c, i + 2)), pair(x, F.get(c, i + 1)))),
    )
    return F.filter(F.concat(inline, pairs), lambda x: x.isNotNull() & (x["label"] != "") & x["value"].isNotNull() & (x["value"] != ""))


def label_values(rows: DataFrame, longest: int = 80) -> DataFrame:
    """``page, pos, label, value``: ``Label: value`` in one text, a label before the next text, or a two-cell table row."""
    return _as_pages(rows).select("page", F.inline(_labels(longest)))


def notices(rows: DataFrame, aliases: dict[str, list[str]], prefix: bool = False) -> DataFrame:
    """One flat row per page: each field is the first non-empty value of its labels, by alias order, then place.

    ``rows`` are ``whole_pages`` or ``cells``. With ``prefix`` a label may go on after the alias.
    """

    def ranked(rank: int, alias: str) -> Column:
        fits = lambda x: F.startswith(F.lower(x["label"]), F.lit(alias)) if prefix else F.lower(x["label"]) == alias
        return F.transform(F.filter("__labels", fits), lambda x: F.struct(F.lit(rank).alias("rank"), x["pos"].alias("pos"), x["value"].alias("value")))

    def first(names: list[str]) -> Column:
        return F.array_min(F.concat(*(ranked(n, a.lower()) for n, a in enumerate(names))))["value"]

    return _as_pages(rows).withColumn("__labels", _labels(80)).select("page", *(first(names).alias(f) for f, names in aliases.items()))


def table_items(rows: DataFrame, headers: dict[str, str], name: str, required: str) -> DataFrame:
    """Item rows of tables whose header row matches ``required``: ``page, tbl, tr`` and a column per header.

    ``rows`` are ``table_rows`` or ``cells``. ``headers`` maps a column to
    the pattern of its header. Rows whose columns are all empty are dropped.
    """
    whole = F.array_join(F.transform("head", lambda x: x["text"]), "|")
    items = _as_table_rows(rows).filter((F.col("tr") > 0) & (F.size("cells") > 0) & whole.rlike(required))

    def value(pattern: str) -> Column:
        place = F.array_min(F.transform(F.filter("head", lambda x: x["text"].rlike(pattern)), lambda x: x["col"]))
        return bind(place, lambda p: F.array_max(F.transform(F.filter("cells", lambda x: x["col"] == p), lambda x: F.nullif(F.trim(x["text"]), F.lit("")))))

    out = items.select("page", "tbl", "tr", *(value(p).alias(h) for h, p in headers.items()))
    return out.filter(F.coalesce(*headers).isNotNull()).withColumn("description", F.col(name))


def award_rows(rows: DataFrame, columns: list[str], required: str) -> DataFrame:
    """Award rows of tables with the wanted header: ``page, tbl, tr`` and its cells by ``columns``; ``rows`` are ``table_rows`` or ``cells``."""
    good = (F.col("tr") > 0) & (F.size("cells") > 0) & F.exists("head", lambda x: x["text"].rlike(required))
    return _as_table_rows(rows).filter(good).select("page", "tbl", "tr", *(_text_at(F.lit(i)).alias(n) for i, n in enumerate(columns)))


def award_list(cell_rows: DataFrame, columns: list[str], required: str, none: str) -> tuple[DataFrame, DataFrame]:
    """``award_rows``, and rejects ``page, reason`` of pages that are malformed.

    A page that says there are no records is empty and no reject.
    """
    said = lambda pattern: F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    good = (F.col("kind") == "cell") & F.coalesce(F.col("tr") == 0, F.lit(False)) & said(required)
    bad = cell_rows.groupBy("page").agg(F.bool_or(good | said(none)).alias("__fine")).filter("NOT __fine").select("page")
    return award_rows(cell_rows, columns, required), bad.withColumn("reason", F.lit("no award header"))
