"""Small text functions: cleaning, keys, names, labels and links, as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The provenance field: a value and where it comes from.
FIELD = "struct<value:string,num:double,source:string,page:int,confidence:string,scope:string,role:string,note:string,constraint:string,quantity:int,unit:string>"
_EXTRAS = ("scope", "role", "note", "constraint", "quantity", "unit")


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """White space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """A cleaned capture, null if the pattern doesn't occur."""
    return clean(F.regexp_extract(text, pattern, group))


def field(value: Column, source: Column | str, page: Column | None = None, confidence: str = "high", **extras: Column) -> Column:
    """A provenance field; a blank value gives a null field."""
    if unknown := set(extras) - {*_EXTRAS, "num"}:
        raise ValueError(f"no such parts of a field: {sorted(unknown)}")
    where = F.lit(source) if isinstance(source, str) else source

    def built(text: Column) -> Column:
        parts = [
            text.alias("value"), extras.get("num", text.try_cast("double")).alias("num"), where.alias("source"),
            (page if page is not None else F.lit(None)).cast("int").alias("page"), F.lit(confidence).alias("confidence"),
            *(extras.get(k, F.lit(None)).alias(k) for k in _EXTRAS),
        ]
        return F.when(text.isNotNull(), F.struct(*parts).cast(FIELD))

    return bind(clean(value.cast("string")), built)


def portal_of(source: Column, key: Column) -> Column:
    """Legacy or current, by an explicit source, else by the key's prefix."""
    s = F.lower(F.trim(source))
    return F.when(s.isin("legacy", "old"), "legacy").when(s.isin("current", "modern"), "current").when(key.startswith("legacy-"), "legacy").otherwise("current")


def safe_key(key: Column) -> Column:
    """Digits, or digits after ``legacy-``."""
    return F.coalesce(key.rlike("^([0-9]+|legacy-[0-9]+)$"), F.lit(False))


def reference_number(text: Column, least: int = 3, most: int = 12) -> Column:
    """A trimmed reference of digits of some length, else null."""
    t = F.trim(text)
    return F.when(t.rlike(f"^[0-9]{{{least},{most}}}$"), t)


def notice_id(text: Column) -> Column:
    """A notice id from a number or from the last number of a URL."""
    return F.coalesce(F.nullif(F.regexp_extract(text, "^([0-9]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"([0-9]+)[^0-9]*$", 1), F.lit("")))


def mapped(value: Column, labels: dict[str, str], fallback: str) -> Column:
    """A label for a code, the fallback for others and for null."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(fallback))


def shown(value: Column, blank: str = "-") -> Column:
    """The trimmed text, or a sign for nothing."""
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit(blank))


def padded(n: Column, width: int = 3) -> Column:
    """A count with leading zeros; longer ones stay whole."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def detail_url(key: Column, base: str) -> Column:
    """A link from a key; null for an unsafe one."""
    return F.when(safe_key(key), F.concat(F.lit(base), key))


def party_name(name: Column) -> Column:
    """Upper case, ``&`` as AND, anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), "&", " AND "), "[^A-Z0-9]+", " "))


def duration(text: Column) -> Column:
    """``struct(constraint, number, unit, wording)`` of a duration; ``one (1) year`` is 1 year."""
    words = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "twelve": 12}
    pattern = rf"(?i)(at\s+least|minimum\s+of|not\s+more\s+than|maximum\s+of|up\s+to)?\s*(\b{r'\b|\b'.join(words)}\b)?\s*\(?\s*([0-9]+)?\s*\)?[\s-]*(year|month|day)s?"
    part = lambda i: F.regexp_extract(text, pattern, i)
    limit = F.lower(F.regexp_replace(part(1), r"\s+", " "))
    constraint = F.when(limit.isin("at least", "minimum of"), "minimum").when(limit != "", "maximum")
    pairs = [F.lit(x) for kv in words.items() for x in kv]
    number = F.coalesce(part(3).try_cast("int"), F.try_element_at(F.create_map(*pairs), F.lower(part(2))))
    found = F.struct(constraint.alias("constraint"), number.alias("number"), F.lower(part(4)).alias("unit"), clean(part(0)).alias("wording"))
    return F.when((part(4) != "") & number.isNotNull(), found)


def emails(text: Column) -> Column:
    """E5: all addresses of a text, as written, in order."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[A-Za-z0-9]"), F.lit(0))


def screened_emails(text: Column, official: str = r"\.gov(\.|$)") -> Column:
    """E5: ``struct(chosen, candidates)``; addresses of an odd form are candidates and never chosen; official ones come first."""
    ok = r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
    good = lambda e: e.rlike(ok) & ~e.contains("..")
    found = F.array_distinct(emails(text))
    fine = F.filter(found, good)
    first_official = F.get(F.filter(fine, lambda e: e.rlike(official)), F.lit(0))
    return F.struct(F.coalesce(first_official, F.get(fine, F.lit(0))).alias("chosen"), F.filter(found, lambda e: ~good(e)).alias("candidates"))


def base_name(text: Column) -> Column:
    """What follows the last slash of either kind, without quotes around it; null if nothing is left."""
    last = F.regexp_extract(F.trim(text), r"([^/\\]*)$", 1)
    return F.nullif(F.trim(F.regexp_replace(last, "^\"+|\"+$", "")), F.lit(""))


def _unescaped(text: Column) -> Column:
    """Percent escapes of UTF-8 decoded, or the text as it is where they can't be; a plus stays one."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def disposition_name(header: Column) -> Column:
    """The file name in a content-disposition header: the extended form (``charset'lang'escaped``) before the plain one."""
    extended = F.regexp_replace(F.trim(F.regexp_extract(header, r"(?i)filename\*\s*=\s*([^;]+)", 1)), '^"(.*)"$', "$1")
    coded = F.regexp_extract(extended, "^[^']*'[^']*'(.*)$", 1)
    plain = F.regexp_extract(header, r'(?i)filename\s*=\s*(?:"([^"]*)"|([^";]+))', 1)
    plain = F.when(plain != "", plain).otherwise(F.regexp_extract(header, r'(?i)filename\s*=\s*(?:"([^"]*)"|([^";]+))', 2))
    return base_name(F.when(extended != "", F.when(coded != "", _unescaped(coded)).otherwise(extended)).otherwise(plain))


def url_name(url: Column) -> Column:
    """The last part of a URL's path, unescaped; null if the path ends in a slash or is empty."""
    path = F.regexp_extract(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "^([^?#]*)", 1)
    return _unescaped(F.nullif(F.regexp_extract(path, "([^/]*)$", 1), F.lit("")))


def looks_like_file_name(name: Column) -> Column:
    """Whether a name has a stem of its own and an extension of 1 to 8 letters or digits; ``download.pdf`` and the like don't."""
    base = F.coalesce(base_name(name), F.lit(""))
    return base.rlike(r"^.+\.[A-Za-z0-9]{1,8}$") & ~base.contains("..") & ~base.rlike(r"(?i)^(download|attachment|file|document)\.[^.]*$")


def attachment_names(df: DataFrame, key: str, order: str, *candidates: Column, extension: str = "pdf", out: str = "name", place: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per row the first candidate that looks like a file name, made safe and free within the notice.

    Candidates are tried in order, such as a link's text, ``disposition_name``
    and ``url_name``. Rows without one are called after the key and their
    place, which ``place`` writes: in at least two digits, if it isn't given.
    Names are compared in lower case.
    """
    plausible = lambda c: F.when(looks_like_file_name(c), base_name(c))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    fallback = F.concat(F.col(key).cast("string"), F.lit("_"), place(rn) if place else padded(rn, 2), F.lit(f".{extension}"))
    safe = F.regexp_replace(F.coalesce(*map(plausible, candidates)), "[^A-Za-z0-9._ -]+", "_")
    named = df.withColumn("__base", F.coalesce(safe, fallback))
    return collision_suffix(named, key, order, "__base", out).drop("__base")


#: A name as its stem, without numbers at its end, these numbers, and its extension.
_NAME = r"(?s)^(.+?)((?:_[0-9]+)*)(\.[A-Za-z0-9]{1,5})?$"


def collision_suffix(df: DataFrame, key: str, order: str, name: str, out: str) -> DataFrame:
    """Names made free within ``key``: in ``order``, a name in use gets the least ``_n`` before its extension that isn't.

    Names are compared in lower case; a null name stays null. Names can only
    meet if they are equal up to numbers at their ends, so these families are
    judged by themselves. In a family of one name the n-th repeat gets ``_n``,
    which is a window; a family with several is folded in order by one task,
    as a stream that keeps the names in use and not the rows.
    """
    lower = F.lower(F.col(name))
    family = F.concat(F.regexp_extract(lower, _NAME, 1), F.lit("/"), F.regexp_extract(lower, _NAME, 3))
    rows = df.withColumns({"__family": F.when(lower.rlike("^(_[0-9]+)*$"), "/").otherwise(family), "__lower": lower})
    family = Window.partitionBy(key, "__family")
    rows = rows.withColumn("__several", F.min("__lower").over(family) != F.max("__lower").over(family))
    n = F.row_number().over(family.orderBy(order)) - 1
    stem, ext = F.regexp_extract(name, r"(?s)^(.+?)(\.[A-Za-z0-9]{1,5})?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[A-Za-z0-9]{1,5})?$", 2)
    numbered = F.when(F.col(name).isNull() | (n == 0), F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext))
    plain = rows.filter(~F.coalesce("__several", F.lit(False))).withColumn(out, numbered)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, following = None, set(), {}
        for batch in batches:
            groups = zip(batch.column("__key").to_pylist(), batch.column("__family").to_pylist())
            free = []
            for now, own, stem, ext in zip(groups, batch.column("__own").to_pylist(), batch.column("__stem").to_pylist(), batch.column("__ext").to_pylist()):
                if now != group:
                    group, used, following = now, set(), {}
                found, low = own, own.lower()
                if low in used:
                    k = following.get(low, 1)
                    while (found := f"{stem}_{k}{ext}").lower() in used:
                        k += 1
                    following[low] = k + 1
                used.add(found.lower())
                free.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(free, pa.string())], ["__row", "free"])

    several = rows.filter("__several").select(F.struct(*df.columns).alias("__row"), F.col(key).cast("string").alias("__key"), "__family", F.col(name).alias("__own"), stem.alias("__stem"), ext.alias("__ext"), F.col(order).alias("__order"))
    dealt = several.repartition("__key", "__family").sortWithinPartitions("__key", "__family", "__order")
    kinds = StructType([dealt.schema["__row"], StructField("free", StringType())])
    folded = dealt.mapInArrow(fold, kinds).select("__row.*", F.col("free").alias(out))
    return plain.select(*df.columns, out).unionByName(folded)
