"""Scalar text, map and JSON functions as native Columns."""

from __future__ import annotations

import base64
import gzip
import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space around and inside text (ASCII controls and space, and the
#: non-breaking space as a character and as an entity).
_EDGE = r"^[\x00-\x20 ]+|[\x00-\x20 ]+$"
_RUN = r"(?:&nbsp;|&amp;nbsp;|&#160;|[\x00-\x20 ])+"


def is_blank(c: Column) -> Column:
    """Null, empty or only characters up to U+0020; a blank is the same as no value."""
    return c.isNull() | (trim_all(c) == "")


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def same_text(a: Column, b: Column) -> Column:
    """Equality in which all blanks are one value."""
    return blank_to_null(a).eqNullSafe(blank_to_null(b))


def strip(c: Column, pipes: bool = False) -> Column:
    """White-space runs (and pipes, if asked) become one space, edges go; null is ''."""
    run = _RUN.replace("[\\x00", "[|\\x00") if pipes else _RUN
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), run, " "))


def trim_all(c: Column) -> Column:
    """Drops leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def collapsed_length(c: Column) -> Column:
    """Length with every white-space run counted as one character."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "&nbsp;|&amp;nbsp;", " ")
    return F.length(F.regexp_replace(trim_all(text), r"[\x09-\x0D\x1C-\x20]+", " "))


def strip_attributes(page: Column) -> Column:
    """HTML with the attributes of start tags taken out."""
    return F.regexp_replace(page, r"<([A-Za-z][A-Za-z0-9]*)\s[^>]*>", "<$1>")


def next_break(text: Column, start: int = 1) -> Column:
    """1-based place of the next sentence or line end, 0 if there is none."""
    return F.regexp_instr(F.substring(text, start, 1 << 30), F.lit(r"\. |[\n\r\f]"))


#: Common entities, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")]


def decode_entities(c: Column) -> Column:
    """The common entities decoded, natively; :func:`unescape` knows all."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def unescape(c: Column) -> Column:
    """All HTML entities decoded: named (some without their semicolon), decimal and hexadecimal, as HTML5 reads them. Null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)

    return run(c)


def compressed(c: Column) -> Column:
    """A text as base64 of its gzip, in Arrow batches; null stays null. The same text gives the same bytes."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: base64.b64encode(gzip.compress(t.encode("utf-8", "surrogatepass"), mtime=0)).decode() if isinstance(t, str) else None)

    return run(c)


def decompressed(c: Column) -> Column:
    """The text of :func:`compressed`."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: gzip.decompress(base64.b64decode(t)).decode("utf-8", "surrogatepass") if isinstance(t, str) else None)

    return run(c)


def encode_entities(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def join_all(items: Column, delimiter: str) -> Column:
    """Array elements joined, null as ''."""
    return F.array_join(F.transform(items, lambda x: F.coalesce(x, F.lit(""))), delimiter)


def day_of_millis(c: Column) -> Column:
    """yyyy-MM-dd (UTC) of epoch milliseconds."""
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")


def map_hash(m: Column) -> Column:
    """sha256 of a string map's sorted ``key:value,`` pairs; the order of entries does not matter."""
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("")))))
    return F.sha2(F.concat(F.array_join(pairs, ","), F.lit(",")), 256)


def merge_maps(left: Column, right: Column) -> Column:
    """Entries of both maps; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def to_int(c: Column) -> Column:
    """An int of any number or numeric string, else 0."""
    return F.coalesce(c.try_cast("double").cast("int"), F.lit(0))


def indexed_list(m: Column, field: str, count: Column) -> Column:
    """field0, field1 ... of a map as an array; a missing index takes the plain field, then field0."""
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.coalesce(F.try_element_at(m, F.concat(F.lit(field), i.cast("string"))), F.try_element_at(m, F.lit(field)), F.try_element_at(m, F.lit(field + "0"))),
    )


def symmetric_difference(a: Column, b: Column) -> Column:
    """How many elements lie in one array only."""
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def sentences(c: Column) -> Column:
    """Sentences by end marks and line breaks."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|[\r\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def stem(word: Column) -> Column:
    """A lower-case word without common English endings."""
    w = F.lower(word)
    for ending, to in (("(?<=[a-z]{3})ies$", "y"), ("(?<=s)es$", ""), ("(?<=[a-z]{3})(?<!s)s$", ""), ("(?<=[a-z]{3})ing$", ""), ("(?<=[a-z]{3})ed$", "")):
        w = F.regexp_replace(w, ending, to)
    return w


def has_stem(query: Column, target: Column) -> Column:
    """Whether any word of the query shares a stem with the target."""
    stems = lambda c: F.transform(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), stem)
    return F.arrays_overlap(stems(query), stems(target))
